"""Draws: repeatable under any partitioning, right in mean and spread."""

import math
from fractions import Fraction

import pytest
from panelcast.operators.draws import (
    binomial_draws,
    binomial_tables,
    keyed_uniform,
    margin_summary,
    turnout_draws,
)
from pyspark.sql import functions as F


def probabilities(spark, parts=1):
    rows = [(f"u{i}", 1000 + 10 * i, 0.3 + 0.01 * i, 0.4 - 0.01 * i) for i in range(12)]
    return spark.createDataFrame(rows, "unit STRING, n BIGINT, p_d DOUBLE, p_r DOUBLE").repartition(parts)


def draw(spark, parts, n=2500, seed=1):
    return binomial_draws(probabilities(spark, parts), ["unit"], "n", {"d": "p_d", "r": "p_r"}, n, seed)


def test_partitioning_does_not_change_draws(spark):
    def rows(parts):
        return sorted(map(tuple, draw(spark, parts).collect()))

    first = rows(1)
    assert len(first) == 12 * 2500
    assert rows(4) == first and rows(64) == first
    assert sorted(map(tuple, draw(spark, 1, seed=2).collect())) != first


def test_blocks_are_distinct_and_numbered(spark):
    df = draw(spark, 3).filter("unit = 'u3'")
    assert df.select("draw").distinct().count() == 2500
    assert df.agg(F.min("draw"), F.max("draw")).first()[:] == (1, 2500)
    head = [r["d"] for r in df.filter("draw <= 1000").orderBy("draw").collect()]
    tail = [r["d"] for r in df.filter("draw > 1000 AND draw <= 2000").orderBy("draw").collect()]
    assert head != tail


def test_mean_and_variance(spark):
    for r in draw(spark, 2, n=5000).groupBy("unit").agg(F.avg("d").alias("m"), F.var_samp("d").alias("v")).collect():
        i = int(r["unit"][1:])
        n, p = 1000 + 10 * i, 0.3 + 0.01 * i
        variance = n * p * (1 - p)
        assert abs(r["m"] - n * p) < 4 * math.sqrt(variance / 5000)
        assert abs(r["v"] - variance) < 4 * variance * math.sqrt(2 / 5000)


def binomial_cdf(n, p):
    """Exact chances in rational numbers."""
    p = Fraction(p)
    total, out = Fraction(0), []
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        out.append(float(total))
    return out


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (7, 0.3), (40, 0.01), (300, 0.45), (300, 0.999), (2000, 0.002)])
def test_tables_are_the_binomial_distribution(spark, n, p):
    df = spark.createDataFrame([("a", n, p)], "k STRING, n BIGINT, p DOUBLE")
    row = binomial_tables(df, ["k"], "n", {"d": "p"}).first()
    cdf = binomial_cdf(n, p)
    assert row["upto"] == pytest.approx(cdf[row["lo"] : row["lo"] + len(row["upto"])], abs=2e-13)
    assert row["upto"][-1] == 1.0 and (row["lo"] == 0 or cdf[row["lo"] - 1] < 2**-52)


def test_draws_invert_the_distribution(spark):
    df = spark.createDataFrame([("a", 60, 0.4)], "k STRING, n BIGINT, p DOUBLE")
    u = keyed_uniform(3, F.col("k"), F.lit("d"), F.col("draw"))
    rows = binomial_draws(df, ["k"], "n", {"d": "p"}, 3000, 3).withColumn("u", u).collect()
    cdf = binomial_cdf(60, 0.4)
    assert len(rows) == 3000
    for r in rows:
        assert r["d"] == sum(c <= r["u"] for c in cdf)


def test_large_sizes_have_bounded_tables(spark):
    df = spark.createDataFrame([("a", 20_000_000, 0.4), ("b", -5, 0.4)], "k STRING, n BIGINT, p DOUBLE")
    assert binomial_tables(df.where("k = 'a'"), ["k"], "n", {"d": "p"}).select(F.size("upto")).first()[0] < 45_000
    draws = binomial_draws(df, ["k"], "n", {"d": "p"}, 2000, 5)
    row = draws.where("k = 'a'").agg(F.avg("d").alias("m"), F.stddev("d").alias("s")).first()
    sd = math.sqrt(20_000_000 * 0.24)
    assert abs(row["m"] - 8_000_000) < 4 * sd / math.sqrt(2000) and abs(row["s"] / sd - 1) < 0.1
    assert draws.where("k = 'b' AND d IS NULL").count() == 2000


def test_no_python_on_the_path(spark):
    plan = draw(spark, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_keys_without_a_probability_stay_with_nulls(spark):
    rows = [("a", 10, None, 0.5), ("b", 10, 0.0, 1.0), ("c", None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "unit STRING, n BIGINT, p_d DOUBLE, p_r DOUBLE")
    draws = binomial_draws(df, ["unit"], "n", {"d": "p_d", "r": "p_r"}, 5, 1)
    got = draws.collect()
    assert sorted({(r["unit"], r["draw"]) for r in got}) == [(u, i) for u in "abc" for i in range(1, 6)]
    assert {(r["d"], r["r"]) for r in got if r["unit"] == "b"} == {(0, 10)}
    assert all(r["d"] is None and r["r"] is not None for r in got if r["unit"] == "a")
    assert all(r["d"] is None and r["r"] is None for r in got if r["unit"] == "c")
    summary = {r["k"]: r for r in margin_summary(draws.withColumnRenamed("unit", "k"), ["k"], "d", "r", (0.5,)).collect()}
    assert (summary["a"]["draws"], summary["a"]["win_rate"], summary["a"]["q50"]) == (0, None, None)
    assert summary["b"]["draws"] == 5 and set(summary) == {"a", "b", "c"}


def test_margin_summary(spark):
    df = spark.createDataFrame([("a", 6, 4), ("a", 4, 6), ("a", 8, 2), ("a", 5, 5)], "k STRING, d INT, r INT")
    row = margin_summary(df, ["k"], "d", "r", (0.5,)).first()
    assert row["draws"] == 4 and row["win_rate"] == 0.5 and row["q50"] == pytest.approx(10.0)


def test_keyed_uniform_covers_the_unit_interval(spark):
    row = (
        spark.range(20000)
        .select(keyed_uniform(7, F.col("id")).alias("u"))
        .agg(F.min("u"), F.max("u"), F.avg("u"), F.var_pop("u"))
        .first()
    )
    assert 0 <= row[0] < 0.001 and 0.999 < row[1] < 1
    assert abs(row[2] - 0.5) < 0.01 and abs(row[3] - 1 / 12) < 0.002


def test_turnout_stays_in_its_bounds(spark):
    out = turnout_draws(
        probabilities(spark), ["unit"], "n", "p_d", "p_r", [("low", 0.45, 0.6, 0.5, 0.5)], 200, 3
    ).join(probabilities(spark), "unit")
    row = out.select(
        (F.col("d_votes") / F.col("n") / F.col("p_d")).alias("d"),
        (F.col("r_votes") / F.col("n") / F.col("p_r")).alias("r"),
    ).agg(F.min("d"), F.max("d"), F.min("r"), F.max("r")).first()
    assert row[0] >= 0.45 - 1e-9 and row[1] <= 0.6 + 1e-9 and row[1] - row[0] > 0.14
    assert row[2] == pytest.approx(0.5) and row[3] == pytest.approx(0.5)
