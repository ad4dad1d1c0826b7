"""Hold every period out at once.

The moments of "all periods but t" are the key's total minus its part, so one pass
over the data serves every hold-out of every key, pooled or not, and nothing is
refitted on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ensemble import FORMULAS, inputs_of, national_inputs
from panelcast.operators.moments import (
    Formula,
    moments,
    quoted,
    total_moments,
    without_part,
)
from panelcast.operators.ols import intercept, predict, slopes, solve, sweep
from panelcast.session import cut_lineage, small_side


def rest_moments(
    df: DataFrame, keys: Sequence[str], period: str, formulas: Sequence[Formula]
) -> DataFrame:
    """Moments of every key without each of its periods, one row per (key, period)."""
    parts = moments(df, [*keys, period], formulas)
    return without_part(total_moments(parts, keys, formulas), formulas)


def holdout_fits(
    df: DataFrame, keys: Sequence[str], period: str, formulas: Sequence[Formula]
) -> DataFrame:
    """One fit per key and held-out period."""
    return solve(rest_moments(df, keys, period, formulas), formulas)


def holdout_unpooled_rows(
    features: DataFrame,
    unit: str = "unit",
    period: str = "year",
    formulas: Sequence[Formula] = FORMULAS,
) -> DataFrame:
    """Each (unit, side, period) predicted by the fit that has not seen the period."""
    keys = [unit, "party", period]
    fits = holdout_fits(features, [unit, "party"], period, formulas)
    return predict(features.select(*keys, *inputs_of(formulas)).join(fits, keys), formulas)


def holdout_pooled_slopes(
    totals: DataFrame,
    keys: Sequence[str],
    groups: Sequence[str],
    period: str,
    formulas: Sequence[Formula],
) -> DataFrame:
    """Common slopes for every held-out period, one row per (group, period).

    ``totals`` holds part and total moments per (key, period). Only keys with rows
    in the period differ from their total, so each period is the grand within-key
    sum minus those differences.
    """
    prefixed = [c for f in formulas for c in f.moment_columns()]
    renamed = totals.selectExpr("*", *[f"all_{c} AS total_{c}" for c in prefixed])
    rest = without_part(renamed, formulas)
    differences = [
        f"sum(total_{f.s(i, j)} - {f.s(i, j)}) AS less_{f.s(i, j)}"
        for f in formulas
        for i, j in f.pairs()
    ]
    less = rest.groupBy(*groups, period).agg(*map(F.expr, differences))
    spreads = [f.s(i, j) for f in formulas for i, j in f.pairs()]
    tolerances = [t for f in formulas for t in f.tolerance_columns()]
    per_key = totals.groupBy(*keys).agg(
        *[F.expr(f"any_value(all_{c}) AS {c}") for c in [*spreads, *tolerances]]
    )
    grand = per_key.groupBy(*groups).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in [*spreads, *tolerances]]
    )
    out = less.join(grand, list(groups))
    coefficients = []
    for f in formulas:
        entries = {(i, j): f"{f.s(i, j)} - less_{f.s(i, j)}" for i, j in f.pairs()}
        out = sweep(out, f.name, f.k + 1, entries, f.tolerance_columns())
        coefficients += slopes(f)
    return out.selectExpr(*quoted([*groups, period]), *coefficients)


def holdout_pooled_rows(
    features: DataFrame,
    unit: str = "unit",
    period: str = "year",
    formulas: Sequence[Formula] = FORMULAS,
) -> DataFrame:
    """Each (unit, side, period) predicted by pooled fits without the period.

    Inputs are the period's national means, the intercept comes from the unit's
    other periods.
    """
    keys = [unit, "party"]
    parts = moments(features, [*keys, period], formulas)
    totals = cut_lineage(total_moments(parts, keys, formulas))
    shared = holdout_pooled_slopes(totals, keys, ["party"], period, formulas).join(
        national_inputs(features, ["party", period], formulas), ["party", period]
    )
    means = without_part(totals, formulas).select(
        *keys, period, *[m for f in formulas for m in f.means()]
    )
    rows = means.join(small_side(shared), ["party", period])
    return predict(rows.selectExpr("*", *[intercept(f) for f in formulas]), formulas)
