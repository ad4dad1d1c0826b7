"""Poll averages: recency, candidate labels, pollster grades, weighted blends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.cleaning import days_left, weeks_left


def label_values(c: str, labels: Mapping[str, str]) -> Column:
    """Named values to labels; anything else is NULL."""
    out = None
    for value, label in labels.items():
        out = F.when(F.col(c) == value, label) if out is None else out.when(F.col(c) == value, label)
    return out


def recent_polls(
    polls: DataFrame,
    event_date: Column,
    end_date: Column,
    unit: str,
    candidate: str,
    parties: Mapping[str, str],
    within_weeks: int,
) -> DataFrame:
    """Polls of known units and candidates that ended within some weeks of the event."""
    return (
        polls.withColumns(
            {
                "party": label_values(candidate, parties),
                "poll_date": end_date,
                "days_left": days_left(event_date, end_date),
                "weeks_left": weeks_left(event_date, end_date),
            }
        )
        .filter(F.col(unit).isNotNull() & F.col("party").isNotNull())
        .filter(F.col("weeks_left") <= within_weeks)
    )


def exact_sum(value: str) -> Column:
    """Decimal sum: poll figures have few digits, and the order of rows must not matter."""
    return F.sum(F.col(value).cast("decimal(20,6)"))


def partial_means(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum and count per key, to be joined to a dimension before the final mean."""
    return df.groupBy(*keys).agg(
        exact_sum(value).alias("part_sum"), F.count(value).alias("part_rows")
    )


def mean_of_parts() -> Column:
    """Exact mean from partial sums and counts."""
    return F.try_divide(
        F.sum("part_sum").cast("double"), F.sum("part_rows").cast("double")
    )


def combine_means(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact mean per key from partial sums and counts."""
    return df.groupBy(*keys).agg(
        mean_of_parts().alias(name),
        F.sum("part_rows").alias("polls"),
    )


def tier_of(grade: str, tiers: DataFrame, df: DataFrame, default: str) -> DataFrame:
    """Attach the tier of each grade; grades outside the table get the default tier."""
    return df.join(tiers, grade, "left").withColumn("tier", F.coalesce("tier", F.lit(default)))


def tier_blend(
    partials: DataFrame, keys: Sequence[str], weights: Mapping[str, float], name: str
) -> DataFrame:
    """Mean per tier side by side, and their fixed-weight sum.

    Each tier uses its own rows; a key without polls in some tier has no blend.
    """
    aggregates = []
    for tier in weights:
        here = F.col("tier") == tier
        total = F.sum(F.when(here, F.col("part_sum")))
        rows = F.sum(F.when(here, F.col("part_rows")))
        aggregates.append(F.try_divide(total.cast("double"), rows.cast("double")).alias(f"tier_{tier.lower()}"))
    out = partials.groupBy(*keys).agg(*aggregates)
    blended = None
    for tier, weight in weights.items():
        part = F.col(f"tier_{tier.lower()}") * F.lit(weight)
        blended = part if blended is None else blended + part
    return out.withColumn(name, blended)
