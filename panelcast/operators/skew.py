"""Joins in which a key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that the one-pass summary keeps; it finds every key with more than about 1/300 of the rows.
TRACKED = 1024
MOST_HEAVY = 256


def heavy_hashes(df: DataFrame, keys: Sequence[str], parts: int) -> list[tuple[int, int]]:
    """Hashes of keys that hold more than half a partition's even share, and how many parts they need.

    One pass with a mergeable summary of bounded size: nothing is shuffled but summaries.
    """
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    row = hashed.selectExpr("count(*) AS n", f"approx_top_k(h, {MOST_HEAVY}, {TRACKED}) AS top").first()
    even = max(row["n"] / parts, 1)
    return [(e["item"], 1 + int(2 * e["count"] / even)) for e in row["top"] or [] if e["count"] > even / 2]


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``keys``; a key with many rows on the left is split.

    Heavy keys, told by their hash, are dealt over several tasks, and only their rows of ``right`` are copied as
    often. All other keys join as they would without. ``how`` is inner, left, left_semi or left_anti: every row
    of ``left`` is in one part, so the result is that of the plain join. Both sides are shuffled once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot split a {how} join")
    spark = left.sparkSession
    heavy = heavy_hashes(left, keys, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not heavy:
        return left.join(right, list(keys), how)
    parts = F.lit(1)
    for h, n in heavy:
        parts = F.when(F.col("__hash") == h, n).otherwise(parts)
    hashed = lambda df: df.withColumn("__hash", F.xxhash64(*keys)).withColumn("__parts", parts)
    dealt = hashed(left).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.col("__parts")).cast("int"))
    copied = hashed(right).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    dealt, copied = dealt.drop("__hash", "__parts"), copied.drop("__hash", "__parts")
    return dealt.join(copied, [*keys, "__part"], how).drop("__part")
