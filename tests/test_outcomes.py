"""Outcome tables, ensembles and moment merging on literal tables."""

import math

import pytest
from panelcast.operators.ensemble import combine_sides, interval_rows
from panelcast.operators.moments import Formula, moments, total_moments, without_part
from panelcast.operators.outcomes import (
    compare_to_actual,
    confusion,
    error_rollup,
    weighted_totals,
)
from panelcast.session import ensure_checkpoint_dir
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def compared(spark):
    forecast = spark.createDataFrame(
        [("a", 55.0, 45.0), ("b", 48.0, 52.0), ("c", 50.0, 50.0), ("d", None, 40.0)],
        "unit STRING, dem_p DOUBLE, rep_p DOUBLE",
    )
    actual = spark.createDataFrame(
        [("a", 52.0, 44.0), ("b", 51.0, 47.0), ("c", 49.0, 50.0), ("d", 30.0, 60.0)],
        "unit STRING, d_actual DOUBLE, r_actual DOUBLE",
    )
    return compare_to_actual(forecast, actual, ["unit"])


def test_errors_and_winners(compared):
    rows = {r["unit"]: r for r in compared.collect()}
    assert rows["a"]["margin_error"] == 2.0 and rows["a"]["d_error"] == 3.0
    assert rows["b"]["actual_winner"] == "D" and rows["b"]["predicted_winner"] == "R"
    assert rows["c"]["predicted_winner"] is None and rows["d"]["d_error"] is None
    counts = {(r[0], r[1]): r[2] for r in confusion(compared).collect()}
    assert counts == {("D", "D"): 1, ("D", "R"): 1, ("R", None): 2}


def test_rollup_covers_all_flagged_and_rest(compared):
    flagged = compared.withColumn("key_unit", F.col("unit").isin("a", "b"))
    rows = {r["category"]: r for r in error_rollup(flagged, "key_unit", ("All", "Key", "Rest")).collect()}
    assert {k: r["units"] for k, r in rows.items()} == {"All": 4, "Key": 2, "Rest": 2}
    assert rows["Key"]["hit_rate"] == 0.5 and rows["Key"]["avg_margin"] == (2.0 + 8.0) / 2
    # an undecided prediction is neither a hit nor a miss
    assert rows["Rest"]["hit_rate"] is None and rows["Rest"]["avg_d"] == 1.0


def test_weighted_totals_with_an_external_unit(spark, compared):
    weights = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30), ("d", 40)], "unit STRING, ev BIGINT")
    external = spark.createDataFrame([("D", 3)], "predicted_winner STRING, ev BIGINT")
    out = weighted_totals(compared, "predicted_winner", weights, "unit", "ev", external)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == {"D": (13, 2), "R": (20, 1)}


def test_both_sides_fold_into_one_forecast(spark):
    rows = [
        ("u", "D", 48.0, 60.0, 0.5, 0.7, 1.0, 3.0),
        ("u", "R", 44.0, 40.0, 0.1, 0.3, 2.0, 4.0),
        ("v", "D", 50.0, None, 0.5, None, 1.0, None),
        ("v", "R", 45.0, 40.0, 0.1, 0.3, 2.0, 4.0),
    ]
    schema = (
        "unit STRING, party STRING, polls_fit DOUBLE, plus_fit DOUBLE, polls_r2 DOUBLE, plus_r2 DOUBLE, "
        "polls_mse DOUBLE, plus_mse DOUBLE"
    )
    got = {r["unit"]: r for r in combine_sides(spark.createDataFrame(rows, schema), ["unit"]).collect()}
    assert got["u"]["dem_p"] == pytest.approx(0.5 * 48 + 0.5 * 60)
    assert got["u"]["rep_p"] == pytest.approx(0.5 * 44 + 0.5 * 40)
    assert got["u"]["winner"] == "D" and got["u"]["d_rsquared"] == pytest.approx(0.6)
    assert got["v"]["dem_p"] is None and got["v"]["winner"] is None


def test_interval_rows(spark):
    names = [f"{s}_{m}{e}" for s in "dr" for m in ("plus", "polls") for e in ("", "_low", "_high")]
    wide = spark.createDataFrame([("u", *[float(i) for i in range(12)])], ["unit", *names])
    rows = {(r["party"], r["model"]): (r["point"], r["low"], r["high"]) for r in interval_rows(wide, ["unit"]).collect()}
    assert rows["D", "plus"] == (0.0, 1.0, 2.0) and rows["R", "polls"] == (9.0, 10.0, 11.0)
    assert len(rows) == 4


def test_merged_parts_equal_the_whole(spark):
    """A third of the rows in one key, uneven parts, an offset far from zero."""
    f = Formula("m", "y", ("a", "b"))
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS k",
        "CAST(id % 5 * id % 7 AS INT) AS t",
        "1e6 + rand(1) AS a",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE rand(2) END AS b",
        "rand(3) * 100 AS y",
    )
    whole = {r["k"]: r for r in moments(rows, ["k"], [f]).collect()}
    totals = total_moments(moments(rows, ["k", "t"], [f]), ["k"], [f])
    for r in totals.collect():
        for c in f.moment_columns():
            assert math.isclose(r[f"all_{c}"], whole[r["k"]][c], rel_tol=1e-6, abs_tol=1e-6)
    rest = {(r["k"], r["t"]): r for r in without_part(totals, [f]).collect()}
    direct = {r["k"]: r for r in moments(rows.filter("t != 2"), ["k"], [f]).collect()}
    checked = 0
    for k, r in direct.items():
        if (k, 2) in rest:
            checked += 1
            for c in f.moment_columns():
                assert math.isclose(rest[k, 2][c], r[c], rel_tol=1e-6, abs_tol=1e-5)
    assert checked > 5


class _Context:
    master = "spark://cluster:7077"

    def getCheckpointDir(self):
        return None


class _Cluster:
    sparkContext = _Context()

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_checkpoint_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Cluster())
