"""Lags and places over groups of any length; joins with heavy keys."""

import random

import pytest
from panelcast.operators.ordered import lag_any_length, order_indexes, splitters
from panelcast.operators.skew import heavy_hashes, split_join
from pyspark.sql import Window
from pyspark.sql import functions as F

SCHEMA = "g STRING, t INT, id INT, v DOUBLE, __x STRING"


def rows(n=1500):
    rng = random.Random(4)
    pick = lambda i: "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "c", "only"])
    return [(pick(i), rng.choice([None, *range(40)]), i, rng.choice([None, 0.5 * i]), "x") for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).checkpoint()


NEW = {"one": ("v", 1), "three": ("id", 3), "next": ("id", -2)}


@pytest.mark.parametrize("keys", [["g"], []])
@pytest.mark.parametrize("block_rows", [10_000, 100, 7])
def test_lags_equal_those_of_a_window(table, keys, block_rows):
    if block_rows == 7 and keys:
        table = table.where("id < 300")
    got = lag_any_length(table, keys, ["t", "id"], NEW, block_rows)
    w = Window.partitionBy(*keys).orderBy("t", "id")
    expected = table.withColumns({name: F.lag(c, n).over(w) for name, (c, n) in NEW.items()})
    assert got.columns == expected.columns
    order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[2])
    assert order(got) == order(expected)


def test_lag_of_an_empty_table(table):
    assert lag_any_length(table.limit(0), ["g"], ["t", "id"], NEW).collect() == []


def test_no_task_has_the_whole_table(table):
    plan = lag_any_length(table, [], ["t", "id"], NEW, 100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_blocks_are_even(table):
    marks = splitters(table, {"x": ["t", "id"], "y": ["g", "id"]}, 150)
    assert all(5 <= len(m) <= 9 for m in marks.values())


@pytest.mark.parametrize("block_rows", [10_000, 100])
def test_places_in_several_orders(table, block_rows):
    got = order_indexes(table, {"by_t": ["t", "id"], "by_v": ["v", "id"], "by_g": ["g", "id"]}, block_rows).collect()
    first = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    for name, key in (("by_t", lambda r: first(r["t"])), ("by_v", lambda r: first(r["v"])), ("by_g", lambda r: text(r["g"]))):
        ids = [r["id"] for r in sorted(got, key=lambda r: r[name])]
        assert ids == [r["id"] for r in sorted(got, key=lambda r: (key(r), r["id"]))]
        assert sorted(r[name] for r in got) == list(range(1, len(got) + 1))


def skewed(spark, n=60_000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("k"), "id")


def test_heavy_keys_are_found(spark):
    found = heavy_hashes(skewed(spark), ["k"], 16)
    expected = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    assert [h for h, _ in found] == [expected] and found[0][1] >= 6
    assert heavy_hashes(spark.range(5000).withColumnRenamed("id", "k"), ["k"], 16) == []
    assert heavy_hashes(spark.range(0).withColumnRenamed("id", "k"), ["k"], 16) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_is_the_join(spark, how):
    left = skewed(spark, 3000).withColumn("k", F.when(F.col("id") == 5, None).otherwise(F.col("k")))
    right = spark.range(4000).select(F.pmod("id", F.lit(2500)).alias("k"), F.col("id").alias("w"))
    got, expected = (sorted(map(str, f.collect())) for f in (split_join(left, right, ["k"], how), left.join(right, ["k"], how)))
    assert got == expected
    with pytest.raises(ValueError, match="cannot split"):
        split_join(left, right, ["k"], "full")


def test_a_third_of_the_rows_on_one_key_is_spread(spark):
    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        right = spark.range(5000).withColumnRenamed("id", "k")
        largest = {}
        for name, joined in (("plain", skewed(spark).join(right, "k")), ("split", split_join(skewed(spark), right, ["k"]))):
            sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
            largest[name] = sizes[-1] / sizes[len(sizes) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert largest["plain"] > 5 and largest["split"] < 2
