"""Narrowed quantiles against Spark's own exact percentile."""

import math
import random

import pytest
from panelcast.operators.quantiles import exact_quantiles
from pyspark.sql import functions as F

MARKS = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)


def groups():
    rng = random.Random(3)
    spread = {
        "even": [rng.random() for _ in range(4000)],
        "ties": [float(rng.randrange(3)) for _ in range(3000)],
        "same": [2.5] * 500,
        "one": [7.0],
        "two": [1.0, 2.0],
        "skewed": [math.exp(rng.uniform(-300, 300)) for _ in range(2000)],
        "wide": [-1.7e308, 1.7e308, 0.0, -0.0, 1e-320, *[rng.gauss(0, 1e300) for _ in range(300)]],
        "gaps": [None, math.nan, 3.0, 1.0],
        "nothing": [None, math.nan],
        None: [5.0, 6.0, 8.0],
    }
    return [(k, v, "x") for k, values in spread.items() for v in values]


@pytest.mark.parametrize(("bins", "leaf"), [(1024, 4096), (64, 10)])
def test_equal_to_percentile(spark, bins, leaf):
    rows = groups()
    df = spark.createDataFrame(rows, "k STRING, value DOUBLE, lo STRING").repartition(7)
    got = {r["k"]: (r["n"], r["marks"]) for r in exact_quantiles(df, ["k"], "value", MARKS, bins, leaf).collect()}
    present = df.where(F.col("value").isNotNull() & ~F.isnan("value"))
    marks = F.percentile("value", F.array(*map(F.lit, MARKS)))
    expected = {r["k"]: (r["n"], r["marks"]) for r in present.groupBy("k").agg(F.count("value").alias("n"), marks.alias("marks")).collect()}
    assert got == expected


def test_whole_table_and_empty_table(spark):
    df = spark.range(10_001).select(F.lit("x").alias("a"), (F.col("id") * 0.5).alias("v0"))
    assert exact_quantiles(df, [], "v0", (0.5, 0.999), 64, 50).first()["marks"] == [2500.0, 4995.0]
    assert exact_quantiles(df, ["a"], "v0", (0.5,)).first()["marks"] == [2500.0]
    assert exact_quantiles(df.limit(0), ["a"], "v0", (0.5,)).collect() == []


def test_no_group_is_gathered_above_the_leaf(spark):
    """A third of the rows in one group: every row that leaves a task is a count of a bin."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.rand(5).alias("v0"))
    got = {r["k"]: r["marks"][0] for r in exact_quantiles(df, ["k"], "v0", (0.5,), 256, 100).collect()}
    df = df.groupBy("k").agg(F.percentile("v0", 0.5).alias("m"))
    assert got == {r["k"]: r["m"] for r in df.collect()}
