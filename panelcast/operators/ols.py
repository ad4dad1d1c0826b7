"""Ordinary least squares on moment rows, as column expressions for any number of terms.

The k x k system of each key is solved by sweeping its moment matrix one predictor
at a time, left to right. One sweep leaves the coefficients, the inverse and the
residual sum of squares in place, and a predictor whose pivot has vanished is
skipped, which drops aliased terms in formula order.

Fit columns of a formula ``f``: ``f_b_i`` (NULL when aliased), ``f_b0`` intercept,
``f_inv_i_j`` inverse entries (0 when aliased), ``f_sse``, ``f_sst``, ``f_mse``,
``f_r2``, ``f_adj_r2``, ``f_terms`` (intercept included), ``f_df``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.student import t_p_value, t_quantile
from panelcast.operators.moments import Formula, moments, quoted, within_moments, without
from panelcast.session import cut_lineage, small_side


def sweep(
    df: DataFrame,
    prefix: str,
    size: int,
    entries: Mapping[tuple[int, int], str],
    tolerances: Sequence[str],
) -> DataFrame:
    """Sweep the leading ``len(tolerances)`` pivots of a symmetric matrix.

    ``entries`` holds the upper triangle. Results land in ``<prefix>_a_i_j``;
    ``<prefix>_inv_p`` is NULL for a skipped pivot.
    """

    def a(i: int, j: int) -> str:
        return f"{prefix}_a_{min(i, j)}_{max(i, j)}"

    cells = [(i, j) for i in range(size) for j in range(i, size)]
    out = df.selectExpr("*", *[f"{entries[ij]} AS {a(*ij)}" for ij in cells])
    for p, limit in enumerate(tolerances):
        inv = f"(1D / CASE WHEN {a(p, p)} > {limit} THEN {a(p, p)} END)"
        new = [f"{inv} AS {prefix}_inv_{p}"]
        for i, j in cells:
            if i == p and j == p:
                swept = f"-{inv}"
            elif p in (i, j):
                swept = f"{a(i, j)} * {inv}"
            else:
                swept = f"{a(i, j)} - {a(i, p)} * {a(j, p)} * {inv}"
            new.append(f"coalesce({swept}, {a(i, j)}) AS {a(i, j)}")
        out = out.selectExpr(without([a(i, j) for i, j in cells]), *new)
    return out


def swept_columns(prefix: str, size: int, pivots: int) -> list[str]:
    cells = [f"{prefix}_a_{i}_{j}" for i in range(size) for j in range(i, size)]
    return cells + [f"{prefix}_inv_{p}" for p in range(pivots)]


def _swept(f: Formula) -> list[str]:
    return swept_columns(f.name, f.k + 1, f.k)


def _sweep_formula(df: DataFrame, f: Formula) -> DataFrame:
    return sweep(
        df, f.name, f.k + 1, {(i, j): f.s(i, j) for i, j in f.pairs()}, f.tolerance_columns()
    )


def slopes(f: Formula) -> list[str]:
    """Coefficients out of a swept matrix; an aliased term has none."""
    return [
        f"CASE WHEN {f.name}_inv_{i} IS NOT NULL THEN {f.name}_a_{i}_{f.k} END AS {f.name}_b_{i}"
        for i in range(f.k)
    ]


def _solution(f: Formula) -> list[str]:
    out = slopes(f)
    for i in range(f.k):
        for j in range(i, f.k):
            kept = f"{f.name}_inv_{i} IS NOT NULL AND {f.name}_inv_{j} IS NOT NULL"
            out.append(
                f"CASE WHEN {kept} THEN -{f.name}_a_{i}_{j} ELSE 0D END AS {f.name}_inv_{i}_{j}"
            )
    out.append(f"greatest({f.name}_a_{f.k}_{f.k}, 0D) AS {f.name}_sse")
    kept = [f"CAST({f.name}_inv_{i} IS NOT NULL AS INT)" for i in range(f.k)]
    out.append(f"{' + '.join(kept)} AS {f.name}_kept")
    return out


def intercept(f: Formula) -> str:
    """Intercept from slopes and means."""
    parts = "".join(f" - coalesce({f.name}_b_{i}, 0D) * {f.mean(i)}" for i in range(f.k))
    return f"{f.mean(f.k)}{parts} AS {f.name}_b0"


def _with_quality(df: DataFrame, f: Formula, parameters: str) -> DataFrame:
    """Fit statistics; ``f_sst`` and the parameter count are on the row."""
    n, sse, sst = f.n(), f"{f.name}_sse", f"{f.name}_sst"
    base = df.selectExpr(
        "*",
        intercept(f),
        f"try_divide({sse}, {n}) AS {f.name}_mse",
        f"1D - try_divide({sse}, {sst}) AS {f.name}_r2",
        f"CAST({parameters} AS INT) AS {f.name}_terms",
        f"{n} - ({parameters}) AS {f.name}_df",
    )
    adjusted = f"1D - (1D - {f.name}_r2) * ({n} - 1) / {f.name}_df"
    return base.selectExpr("*", f"CASE WHEN {f.name}_df > 0 THEN {adjusted} END AS {f.name}_adj_r2")


def solve(df: DataFrame, formulas: Sequence[Formula]) -> DataFrame:
    """Fit every formula on a row of its own moments."""
    out = df
    for f in formulas:
        out = _sweep_formula(out, f)
        out = out.selectExpr(
            without(_swept(f)), *_solution(f), f"{f.s(f.k, f.k)} AS {f.name}_sst"
        )
        out = _with_quality(out, f, f"{f.name}_kept + 1").drop(f"{f.name}_kept")
    return out


def ols_by_key(df: DataFrame, keys: Sequence[str], formulas: Sequence[Formula]) -> DataFrame:
    """One regression per key and formula (the unpooled fit)."""
    return solve(moments(df, keys, formulas), formulas)


def pooled_slopes(
    per_key: DataFrame, groups: Sequence[str], formulas: Sequence[Formula]
) -> DataFrame:
    """Common slopes of a fit with one intercept per key, one row per group."""
    out = within_moments(per_key, groups, formulas)
    for f in formulas:
        out = _sweep_formula(out, f)
        used = [*_swept(f), *[f.s(i, j) for i, j in f.pairs()], *f.tolerance_columns()]
        out = out.selectExpr(without(used), *_solution(f))
    return out


def pooled_ols(
    df: DataFrame, keys: Sequence[str], groups: Sequence[str], formulas: Sequence[Formula]
) -> DataFrame:
    """Slopes shared by all keys of a group, an intercept for each key.

    The moments are written once: slopes, spread and intercepts all read them.
    """
    per_key = cut_lineage(moments(df, keys, formulas))
    return pooled_from_moments(per_key, keys, groups, formulas)


def pooled_from_moments(
    per_key: DataFrame,
    keys: Sequence[str],
    groups: Sequence[str],
    formulas: Sequence[Formula],
    inputs: DataFrame | None = None,
) -> DataFrame:
    """The pooled fit from per-key moments: key rows joined to their group's slopes.

    The per-key means and counts stay on the row as ``f_mean_i`` and ``f_key_n``;
    ``f_n`` is the number of rows in the whole fit, as a residual count needs it.
    ``inputs`` (one row per group) travels along to be scored. The group rows are
    counted before they are broadcast, so the key table is not shuffled onto the
    few values of the group columns.
    """
    shared = pooled_slopes(per_key, groups, formulas).join(
        _total_spread(per_key, groups, formulas), list(groups)
    )
    if inputs is not None:
        shared = shared.join(inputs, list(groups))
    shared = small_side(shared)
    key_columns = [
        c for f in formulas for c in [f"{f.n()} AS {f.name}_key_n", *f.means()]
    ]
    out = per_key.selectExpr(*quoted(keys), *key_columns).join(shared, list(groups))
    for f in formulas:
        out = _with_quality(out, f, f"{f.name}_kept + {f.name}_keys").drop(
            f"{f.name}_kept", f"{f.name}_keys"
        )
    return out


def _total_spread(
    per_key: DataFrame, groups: Sequence[str], formulas: Sequence[Formula]
) -> DataFrame:
    """Total sum of squares of each response around its group mean.

    Two steps (the mean, then deviations of key means from it) on the small key
    table, because raw squares would lose the digits that matter.
    """
    centres = [
        f"try_divide(sum({f.n()} * {f.mean(f.k)}), sum({f.n()})) AS {f.name}_centre"
        for f in formulas
    ]
    centre = per_key.groupBy(*groups).agg(*map(F.expr, centres))
    spreads = []
    for f in formulas:
        dev = f"({f.mean(f.k)} - {f.name}_centre)"
        spreads.append(f"sum({f.s(f.k, f.k)} + {f.n()} * {dev} * {dev}) AS {f.name}_sst")
    return per_key.join(centre, list(groups)).groupBy(*groups).agg(*map(F.expr, spreads))


def fitted(f: Formula) -> str:
    """Point prediction from coefficients and predictors on one row; aliased terms are left out."""
    parts = [
        f"CASE WHEN {f.name}_b_{i} IS NULL THEN 0D ELSE {f.name}_b_{i} * CAST(`{x}` AS DOUBLE) END"
        for i, x in enumerate(f.xs)
    ]
    return " + ".join([f"{f.name}_b0", *parts])


def _leverage(f: Formula, count: str) -> str:
    """Squared scale of the mean's standard error: 1/n plus the distance from the means."""
    dev = [f"(CAST(`{x}` AS DOUBLE) - {f.mean(i)})" for i, x in enumerate(f.xs)]
    terms = [f"try_divide(1D, {count})"]
    for i in range(f.k):
        for j in range(f.k):
            entry = f"{f.name}_inv_{min(i, j)}_{max(i, j)}"
            terms.append(f"CASE WHEN {entry} = 0D THEN 0D ELSE {dev[i]} * {dev[j]} * {entry} END")
    return " + ".join(terms)


def predict(
    df: DataFrame, formulas: Sequence[Formula], level: float | None = None, pooled: bool = False
) -> DataFrame:
    """Add ``f_fit`` and, with a level, ``f_lwr``/``f_upr``: an interval of the mean.

    ``df`` carries predictors and fit columns on one row (a scoring table joined
    to the fits on key).
    """
    out = df.selectExpr("*", *[f"{fitted(f)} AS {f.name}_fit" for f in formulas])
    if level is None:
        return out
    halves = []
    for f in formulas:
        count = f"{f.name}_key_n" if pooled else f.n()
        variance = f"try_divide({f.name}_sse, {f.name}_df)"
        quantile = t_quantile(f"{f.name}_df", level)
        halves.append(f"{quantile} * sqrt({variance} * ({_leverage(f, count)})) AS {f.name}_half")
    bounds = [
        f"{f.name}_fit {sign} {f.name}_half AS {f.name}_{name}"
        for f in formulas
        for sign, name in (("-", "lwr"), ("+", "upr"))
    ]
    return out.selectExpr("*", *halves).selectExpr(
        without([f"{f.name}_half" for f in formulas]), *bounds
    )


def slope_tests(fits: DataFrame, f: Formula) -> DataFrame:
    """Add standard error, t statistic and two-sided p-value of every slope."""
    errors = [
        f"CASE WHEN {f.name}_b_{i} IS NOT NULL AND {f.name}_df > 0"
        f" THEN sqrt({f.name}_sse / {f.name}_df * {f.name}_inv_{i}_{i}) END AS {f.name}_se_{i}"
        for i in range(f.k)
    ]
    ratios = [f"try_divide({f.name}_b_{i}, {f.name}_se_{i}) AS {f.name}_t_{i}" for i in range(f.k)]
    out = fits.selectExpr("*", *errors).selectExpr("*", *ratios)
    df = F.col(f"{f.name}_df").cast("double")
    return out.withColumns(
        {f"{f.name}_p_{i}": t_p_value(F.col(f"{f.name}_t_{i}"), df) for i in range(f.k)}
    )


def correlation(f: Formula, i: int = 0) -> Column:
    """Pearson correlation of predictor ``i`` and the response; NULL when one is constant."""
    sxx, syy = f.s(i, i), f.s(f.k, f.k)
    return F.expr(f"try_divide({f.s(i, f.k)}, sqrt({sxx}) * sqrt({syy}))")


def residuals(
    df: DataFrame, fits: DataFrame, keys: Sequence[str], formulas: Sequence[Formula]
) -> DataFrame:
    """Per-row residual of every formula: rows joined back to their key's coefficients.

    Fits that are counted small are broadcast, so that the rows stay where they are.
    """
    names = [c for f in formulas for c in [f"{f.name}_b0", *[f"{f.name}_b_{i}" for i in range(f.k)]]]
    out = predict(df.join(small_side(fits.select(*keys, *names)), list(keys)), formulas)
    return out.selectExpr(
        without(names),
        *[f"CAST(`{f.y}` AS DOUBLE) - {f.name}_fit AS {f.name}_residual" for f in formulas],
    )
