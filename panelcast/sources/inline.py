"""Inline constant tables.

They hold a handful of rows by construction, which is the bound that lets
``broadcast_inline`` hint a broadcast without looking at the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE_LIMIT = 10_000


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A constant table from literal rows."""
    return spark.createDataFrame(list(rows), schema)


def broadcast_inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A constant table hinted for broadcast when it is short enough to be one."""
    df = inline_table(spark, rows, schema)
    return F.broadcast(df) if len(rows) <= INLINE_LIMIT else df


# Pollster grades by tier, and the weight of each tier.
GRADE_TIERS = [
    ("A+", "A"),
    ("A", "A"),
    ("A-", "A"),
    ("A/B", "B"),
    ("B+", "B"),
    ("B", "B"),
    ("B-", "B"),
    ("B/C", "B"),
]
DEFAULT_TIER = "low"
TIER_WEIGHTS = {"A": 0.5, "B": 0.3, "low": 0.2}

# Blend weights of polls against the growth regression.
POLL_WEIGHT = 0.7
GROWTH_WEIGHT = 0.3

# Turnout bounds (low, high) per scenario and side.
TURNOUT_SCENARIOS = [
    ("democratic_advantage", 0.45, 0.60, 0.45, 0.50),
    ("republican_advantage", 0.45, 0.50, 0.45, 0.70),
    ("early_vote_adjusted", 0.45, 0.60, 0.45, 0.55),
]
