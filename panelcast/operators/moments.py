"""Centred cross-moments per key: the one thing every regression here reads.

``moments`` makes a single pass with Spark's own ``covar_pop``/``avg``, which
merge centred partial results. Partial sums are formed before the shuffle, so a
key that owns a third of the rows costs one small row per map task, and no
window or group ever holds raw rows. The pooled fit, the hold-outs and the
intervals are all arithmetic on these small rows.

Columns of a formula ``f`` with predictors x0..x(k-1) and response index k:
``f_n`` rows used, ``f_mean_i``, ``f_s_i_j`` (i <= j) centred cross-products,
``f_tol_i`` the pivot size below which predictor i counts as aliased.

Expressions are SQL text: a fit has dozens of columns, and text reaches the JVM
in one call per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A predictor is aliased when what the intercept and the earlier terms leave of it
# is this small against its raw and its centred sum of squares.
RAW_TOLERANCE = "1e-14D"
CENTRED_TOLERANCE = "1e-10D"


@dataclass(frozen=True)
class Formula:
    """``y ~ xs`` with an intercept; ``name`` prefixes every derived column."""

    name: str
    y: str
    xs: tuple[str, ...]

    @property
    def k(self) -> int:
        return len(self.xs)

    @property
    def variables(self) -> tuple[str, ...]:
        return (*self.xs, self.y)

    def n(self) -> str:
        return f"{self.name}_n"

    def mean(self, i: int) -> str:
        return f"{self.name}_mean_{i}"

    def s(self, i: int, j: int) -> str:
        return f"{self.name}_s_{min(i, j)}_{max(i, j)}"

    def tol(self, i: int) -> str:
        return f"{self.name}_tol_{i}"

    def pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.k + 1) for j in range(i, self.k + 1)]

    def means(self) -> list[str]:
        return [self.mean(i) for i in range(self.k + 1)]

    def moment_columns(self) -> list[str]:
        return [self.n(), *self.means(), *[self.s(i, j) for i, j in self.pairs()]]

    def tolerance_columns(self) -> list[str]:
        return [self.tol(i) for i in range(self.k)]


def quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def without(names: Sequence[str]) -> str:
    """All columns but these."""
    return f"* EXCEPT ({', '.join(quoted(names))})"


def tolerance(n: str, mean: str, spread: str) -> str:
    return f"{n} * {mean} * {mean} * {RAW_TOLERANCE} + {spread} * {CENTRED_TOLERANCE}"


def moments(df: DataFrame, keys: Sequence[str], formulas: Sequence[Formula]) -> DataFrame:
    """Moments of every formula per key in one aggregate.

    Rows are deleted listwise per formula: each formula sees the rows on which
    all of its own variables are present.
    """
    values, aggregates, tolerances = [], [], []
    for f in formulas:
        complete = " AND ".join(f"`{v}` IS NOT NULL" for v in f.variables)
        v = [f"{f.name}_v_{i}" for i in range(f.k + 1)]
        values += [
            f"CASE WHEN {complete} THEN CAST(`{x}` AS DOUBLE) END AS {v[i]}"
            for i, x in enumerate(f.variables)
        ]
        n = f"count({v[f.k]})"
        aggregates.append(f"{n} AS {f.n()}")
        aggregates += [f"avg({v[i]}) AS {f.mean(i)}" for i in range(f.k + 1)]
        for i, j in f.pairs():
            spread = f"var_pop({v[i]})" if i == j else f"covar_pop({v[i]}, {v[j]})"
            aggregates.append(f"{spread} * {n} AS {f.s(i, j)}")
        tolerances += [
            f"{tolerance(f.n(), f.mean(i), f.s(i, i))} AS {f.tol(i)}" for i in range(f.k)
        ]
    rows = df.selectExpr(*quoted(keys), *values)
    return rows.groupBy(*keys).agg(*map(F.expr, aggregates)).selectExpr("*", *tolerances)


def total_moments(parts: DataFrame, keys: Sequence[str], formulas: Sequence[Formula]) -> DataFrame:
    """Add to each (key, part) row the merged moments of its key, prefixed ``all_``.

    ``parts`` has one row per key and period, so a window partition holds as many
    rows as there are periods. Both passes (means, then deviations from them)
    share one window and therefore one shuffle.
    """
    over = f"OVER (PARTITION BY {', '.join(quoted(keys))})"
    means, spreads = [], []
    for f in formulas:
        n = f"sum({f.n()}) {over}"
        means.append(f"{n} AS all_{f.n()}")
        means += [f"try_divide(sum({f.n()} * {m}) {over}, {n}) AS all_{m}" for m in f.means()]
        dev = [f"({m} - all_{m})" for m in f.means()]

        def spread(i: int, j: int, f: Formula = f, dev: list[str] = dev) -> str:
            return f"sum({f.s(i, j)} + {f.n()} * {dev[i]} * {dev[j]}) {over}"

        spreads += [f"{spread(i, j)} AS all_{f.s(i, j)}" for i, j in f.pairs()]
        spreads += [
            f"{tolerance(f'all_{f.n()}', f'all_{f.mean(i)}', spread(i, i))} AS all_{f.tol(i)}"
            for i in range(f.k)
        ]
    return parts.selectExpr("*", *means).selectExpr("*", *spreads)


def without_part(df: DataFrame, formulas: Sequence[Formula]) -> DataFrame:
    """Turn total and part moments on one row into the moments of the rest.

    The inverse of merging centred moments: no row is read again, so holding out
    every period costs the same as holding out one. A part without a complete row
    leaves the total as it is.
    """
    steps, rest, drop = [], [], []
    for f in formulas:
        part = f"coalesce({f.n()}, 0L)"
        steps.append(f"try_divide(CAST({part} AS DOUBLE), all_{f.n()} - {part}) AS {f.name}_ratio")
        steps += [f"coalesce({m} - all_{m}, 0D) AS {f.name}_dev_{i}" for i, m in enumerate(f.means())]
        rest.append(f"all_{f.n()} - {part} AS {f.n()}")
        rest += [
            f"all_{m} - {f.name}_ratio * {f.name}_dev_{i} AS {m}" for i, m in enumerate(f.means())
        ]
        for i, j in f.pairs():
            left = (
                f"all_{f.s(i, j)} - coalesce({f.s(i, j)}, 0D)"
                f" - {f.name}_ratio * all_{f.n()} * {f.name}_dev_{i} * {f.name}_dev_{j}"
            )
            if i == j:
                # cancellation residue of a predictor that is constant in the rest
                left = f"CASE WHEN {left} <= all_{f.s(i, i)} * 1e-12D THEN 0D ELSE {left} END"
            rest.append(f"{left} AS {f.s(i, j)}")
        rest += [f"all_{t} AS {t}" for t in f.tolerance_columns()]
        own = [*f.moment_columns(), *f.tolerance_columns()]
        drop += [*own, *[f"all_{c}" for c in own]]
        drop += [f"{f.name}_ratio", *[f"{f.name}_dev_{i}" for i in range(f.k + 1)]]
    return df.selectExpr("*", *steps).selectExpr(without(drop), *rest)


def within_moments(
    per_key: DataFrame, groups: Sequence[str], formulas: Sequence[Formula]
) -> DataFrame:
    """Moments around each key's own mean, summed over the keys of a group.

    Equal to demeaning every row within its key, without touching a row: this is
    all a fit with one intercept per key needs. ``f_keys`` counts the intercepts.
    """
    aggregates = []
    for f in formulas:
        aggregates.append(f"sum({f.n()}) AS {f.n()}")
        aggregates.append(f"count_if({f.n()} > 0) AS {f.name}_keys")
        aggregates += [f"sum({f.s(i, j)}) AS {f.s(i, j)}" for i, j in f.pairs()]
        aggregates += [f"sum({t}) AS {t}" for t in f.tolerance_columns()]
    return per_key.groupBy(*groups).agg(*map(F.expr, aggregates))
