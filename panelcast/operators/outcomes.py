"""From forecasts to outcomes: errors, hits, weighted totals, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.shares import winner


def compare_to_actual(forecast: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share errors, margins, margin error and both winners on one row per key.

    ``actual`` carries ``d_actual`` and ``r_actual`` on the scale of the forecast.
    """
    out = actual.join(forecast, list(keys))
    return out.withColumns(
        {
            "d_error": F.abs(F.col("d_actual") - F.col("dem_p")),
            "r_error": F.abs(F.col("r_actual") - F.col("rep_p")),
            "actual_margin": F.col("d_actual") - F.col("r_actual"),
            "predicted_margin": F.col("dem_p") - F.col("rep_p"),
            "actual_winner": winner("d_actual", "r_actual"),
            "predicted_winner": winner("dem_p", "rep_p"),
        }
    ).withColumn("margin_error", F.abs(F.col("actual_margin") - F.col("predicted_margin")))


def error_rollup(compared: DataFrame, flag: str, labels: tuple[str, str, str]) -> DataFrame:
    """Mean errors and hit rate over all keys, the flagged ones and the rest, in one pass."""
    everything, flagged, rest = labels
    hit = (F.col("actual_winner") == F.col("predicted_winner")).cast("double")
    return (
        compared.rollup(flag)
        .agg(
            F.grouping(flag).alias("__all"),
            F.avg("d_error").alias("avg_d"),
            F.avg("r_error").alias("avg_r"),
            F.avg("margin_error").alias("avg_margin"),
            F.avg(hit).alias("hit_rate"),
            F.count(F.lit(1)).alias("units"),
        )
        .withColumn(
            "category",
            F.when(F.col("__all") == 1, everything).when(F.col(flag), flagged).otherwise(rest),
        )
        .select("category", "avg_d", "avg_r", "avg_margin", "hit_rate", "units")
    )


def confusion(compared: DataFrame) -> DataFrame:
    """Units by actual and predicted winner."""
    return compared.groupBy("actual_winner", "predicted_winner").agg(
        F.count(F.lit(1)).alias("units")
    )


def weighted_totals(
    labelled: DataFrame, label: str, weights: DataFrame, unit: str, weight: str, external: DataFrame | None = None
) -> DataFrame:
    """Winner-take-all totals: every unit's weight goes to its label.

    ``external`` adds units outside the table as (label, weight) rows.
    """
    rows = labelled.join(weights, unit).select(F.col(label), F.col(weight))
    if external is not None:
        rows = rows.unionByName(external.select(F.col(label), F.col(weight)))
    return (
        rows.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.sum(weight).alias("total_weight"), F.count(F.lit(1)).alias("units"))
    )


def model_metrics(forecast: DataFrame, compared: DataFrame, model: str) -> DataFrame:
    """One row of fit and hold-out quality for the comparison table."""
    fit = forecast.agg(
        F.avg("d_rsquared").alias("d_rsquared"),
        F.avg("r_rsquared").alias("r_rsquared"),
        F.avg("d_mse").alias("d_mse"),
        F.avg("r_mse").alias("r_mse"),
    ).withColumn("model", F.lit(model))
    errors = compared.agg(
        F.avg("margin_error").alias("holdout_error"),
        F.avg((F.col("actual_winner") == F.col("predicted_winner")).cast("double")).alias("hit_rate"),
        F.count("margin_error").alias("holdout_rows"),
    ).withColumn("model", F.lit(model))
    return fit.join(errors, "model")
