"""Two-part ensemble forecasts: a polls model and a fundamentals model per side.

Formulas are named ``plus`` (fundamentals) and ``polls``; their variables are the
caller's. ``rows`` below always means one row per (key, side) carrying the fits and the
predictions of both formulas; ``combine_sides`` folds the two sides of a key into
one forecast row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.shares import DEMOCRAT, REPUBLICAN
from panelcast.operators.moments import Formula, moments, quoted
from panelcast.operators.ols import ols_by_key, pooled_from_moments, predict
from panelcast.session import cut_lineage

PLUS = Formula("plus", "pv", ("lag_pv2p", "segment_chng", "incumbent_party"))
POLLS = Formula("polls", "pv", ("avg_poll",))
FORMULAS = (PLUS, POLLS)
SIDES = {"d": DEMOCRAT, "r": REPUBLICAN}


def unpooled_rows(
    train: DataFrame,
    score: DataFrame,
    unit: str = "unit",
    level: float | None = None,
    formulas: Sequence[Formula] = FORMULAS,
) -> DataFrame:
    """Fit both formulas for every (unit, side) and predict its scoring row."""
    keys = [unit, "party"]
    fits = ols_by_key(train, keys, formulas)
    return predict(
        score.select(*keys, *inputs_of(formulas)).join(fits, keys, "left"), formulas, level
    )


def inputs_of(formulas: Sequence[Formula]) -> list[str]:
    """Every predictor the formulas read, once."""
    return sorted({x for f in formulas for x in f.xs})


def national_inputs(
    score: DataFrame, keys: Sequence[str], formulas: Sequence[Formula] = FORMULAS
) -> DataFrame:
    """Mean of every model input over units, one row per key."""
    means = [F.expr(f"avg(CAST(`{x}` AS DOUBLE)) AS `{x}`") for x in inputs_of(formulas)]
    return score.groupBy(*keys).agg(*means)


def pooled_rows(
    train: DataFrame,
    score: DataFrame,
    unit: str = "unit",
    level: float | None = None,
    formulas: Sequence[Formula] = FORMULAS,
) -> DataFrame:
    """Fit both formulas once per side with unit intercepts; predict all units from national inputs."""
    per_key = cut_lineage(moments(train, [unit, "party"], formulas))
    inputs = national_inputs(score, ["party"], formulas)
    fits = pooled_from_moments(per_key, [unit, "party"], ["party"], formulas, inputs)
    return predict(fits, formulas, level, pooled=True)


def _side(party: str, expression: str, name: str) -> Column:
    return F.expr(f"max(CASE WHEN party = '{party}' THEN {expression} END) AS {name}")


def combine_sides(rows: DataFrame, keys: Sequence[str], quality: bool = True) -> DataFrame:
    """Fold both sides of a key: renormalise the fundamentals pair, blend half and half.

    With ``quality``, R-squared and MSE are the means over the two models.
    """
    folded, kept = [], []
    for s, party in SIDES.items():
        folded.append(_side(party, "polls_fit", f"{s}_polls"))
        folded.append(_side(party, "plus_fit", f"{s}_plus"))
        if quality:
            folded.append(_side(party, "0.5D * plus_r2 + 0.5D * polls_r2", f"{s}_rsquared"))
            folded.append(_side(party, "0.5D * plus_mse + 0.5D * polls_mse", f"{s}_mse"))
            kept += [f"{s}_rsquared", f"{s}_mse"]
    pair = "(d_plus + r_plus)"
    return (
        rows.groupBy(*keys)
        .agg(*folded)
        .selectExpr(
            *quoted(keys),
            f"0.5D * d_polls + 0.5D * try_divide(d_plus * 100D, {pair}) AS dem_p",
            f"0.5D * r_polls + 0.5D * try_divide(r_plus * 100D, {pair}) AS rep_p",
            *kept,
        )
        .selectExpr(
            "*",
            "dem_p - rep_p AS d_margin",
            f"CASE WHEN dem_p > rep_p THEN '{DEMOCRAT}' WHEN rep_p > dem_p THEN '{REPUBLICAN}' END"
            " AS winner",
        )
    )


def interval_columns(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The twelve point/low/high columns of a key: two sides by two models."""
    columns = []
    for s, party in SIDES.items():
        for f in FORMULAS:
            columns.append(_side(party, f"{f.name}_fit", f"{s}_{f.name}"))
            columns.append(_side(party, f"{f.name}_lwr", f"{s}_{f.name}_low"))
            columns.append(_side(party, f"{f.name}_upr", f"{s}_{f.name}_high"))
    return rows.groupBy(*keys).agg(*columns)


def interval_rows(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The twelve columns as rows: key, side, model, point, low, high."""
    entries = ", ".join(
        f"'{party}', '{f.name}', {s}_{f.name}, {s}_{f.name}_low, {s}_{f.name}_high"
        for s, party in SIDES.items()
        for f in FORMULAS
    )
    count = len(SIDES) * len(FORMULAS)
    stacked = f"stack({count}, {entries}) AS (party, model, point, low, high)"
    return wide.selectExpr(*quoted(keys), stacked)
