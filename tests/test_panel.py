"""Panel verbs on literal edge tables."""

import pytest
from panelcast.functions import shares as S
from panelcast.operators.histogram import histogram
from panelcast.operators.panel import (
    assemble_features,
    calendar_lag,
    change_columns,
    every_kth,
    first_row,
    lag_columns,
    members,
    natural_join,
    order_index,
    period_columns,
    strongest,
    wide_to_long,
)
from panelcast.plans import domain
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def gap(spark):
    rows = [("a", y, float(y % 100)) for y in (2000, 2004, 2012, 2016)]
    rows += [("b", y, float(-(y % 100))) for y in (2000, 2004, 2008, 2012)]
    return spark.createDataFrame(rows, "unit STRING, year INT, v DOUBLE")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_lag_counts_rows_and_calendar_lag_counts_periods(gap):
    rows = by(lag_columns(gap, ["unit"], "year", {"p": ("v", 1), "n": ("v", -1)}), "unit", "year")
    assert rows["a", 2012]["p"] == 4.0 and rows["a", 2004]["n"] == 12.0
    assert rows["a", 2000]["p"] is None and rows["b", 2012]["n"] is None
    fixed = by(calendar_lag(gap, ["unit"], "year", 4, {"p": "v"}), "unit", "year")
    assert fixed["a", 2012]["p"] is None and fixed["a", 2016]["p"] == 12.0
    assert len(fixed) == 8


def test_filter_after_the_window_keeps_the_lag(gap):
    out = change_columns(gap, ["unit"], "year", {"d": ("v", 1)}).filter("year > 2000")
    assert by(out, "unit", "year")["b", 2004]["d"] == -4.0


def test_pivot_and_unpivot(gap):
    wide = period_columns(gap, ["unit"], "year", "v", {2008: "y8", 2016: "y16"})
    rows = by(wide, "unit")
    assert rows["a",]["y8"] is None and rows["a",]["y16"] == 16.0
    long = wide_to_long(wide, ["unit"], {"y8": 2008, "y16": 2016}, "year", "v")
    assert long.count() == 4 and by(long, "unit", "year")["b", 2008]["v"] == -8.0
    kept = by(every_kth(gap, "year", 8, 2000), "unit", "year")
    assert set(kept) == {("a", 2000), ("a", 2016), ("b", 2000), ("b", 2008)}


def test_first_row_takes_the_earliest_with_a_tie_breaker(spark):
    rows = [("k", 2, 9, "late"), ("k", 1, 7, "second"), ("k", 1, 3, "first"), ("l", 5, 1, "only")]
    df = spark.createDataFrame(rows, "k STRING, t INT, id INT, v STRING")
    got = by(first_row(df, ["k"], ["t", "id"], ["v"]), "k")
    assert got["k",]["v"] == "first" and got["l",]["v"] == "only"


@pytest.mark.parametrize("parts", [1, 7])
def test_order_index_is_the_global_row_number(spark, parts):
    df = spark.range(500).select(((F.col("id") * 37) % 10).alias("v"), "id").repartition(parts)
    rows = order_index(df, ["v", "id"]).collect()
    expected = sorted((r["v"], r["id"]) for r in rows)
    assert [(r["v"], r["id"]) for r in sorted(rows, key=lambda r: r["order_index"])] == expected
    assert sorted(r["order_index"] for r in rows) == list(range(1, 501))


def test_natural_join_and_membership(spark):
    left = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k INT, s STRING, v INT")
    right = spark.createDataFrame([(1, "x", 7), (2, "z", 8)], "k INT, s STRING, w INT")
    assert [tuple(r) for r in natural_join(left, right).collect()] == [(1, "x", 5, 7)]
    with pytest.raises(ValueError):
        natural_join(left.select("v"), right.select("w"))
    labelled = by(members(left, right.select("s"), ["s"], "m"), "k")
    assert labelled[1,]["m"] == "member" and labelled[2,]["m"] == "other"


def test_strongest_at_both_ends(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 9, 9, -3])], "id INT, v DOUBLE")
    rows = strongest(df, "v", 2, ["id"]).collect()
    assert [r["id"] for r in rows if r["end"] == "top"] == [2, 3]
    assert [r["id"] for r in rows if r["end"] == "bottom"] == [4, 1]


def test_labels_on_ties_and_missing_sides(spark):
    rows = [(1, 2.0, 1.0), (2, 1.0, 1.0), (3, None, 1.0), (4, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id INT, d DOUBLE, r DOUBLE")
    got = by(
        df.select(
            "id",
            S.winner_or_second("d", "r", "D", "R").alias("with_default"),
            S.winner("d", "r").alias("strict"),
            S.two_party_share("d", "r").alias("share"),
            S.two_party_margin("d", "r").alias("margin"),
            S.share_of("d", F.lit(0.0)).alias("of_nothing"),
        ),
        "id",
    )
    assert [got[i,]["with_default"] for i in (1, 2, 3, 4)] == ["D", "R", "R", "R"]
    assert [got[i,]["strict"] for i in (1, 2, 3, 4)] == ["D", None, None, None]
    assert got[4,]["share"] is None and got[4,]["margin"] is None and got[1,]["of_nothing"] is None


def test_parties_in_and_out_of_office(spark):
    rows = [("D", True), ("R", True), ("D", False), ("R", False), ("D", None)]
    df = spark.createDataFrame(rows, "party STRING, inc BOOLEAN")
    got = df.select(S.incumbent_party("party", "inc"), S.challenger_party("party", "inc")).collect()
    assert [tuple(r) for r in got] == [("D", "R"), ("R", "D"), ("R", "D"), ("D", "R"), (None, None)]


def test_strict_mean_is_null_when_a_value_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "k STRING, v DOUBLE")
    got = by(df.groupBy("k").agg(S.strict_avg("v").alias("m"), F.avg("v").alias("loose")), "k")
    assert got["a",]["m"] == 2.0 and got["b",]["m"] is None and got["b",]["loose"] == 1.0


def test_feature_assembly_keeps_rows_of_either_side(spark):
    polls = spark.createDataFrame([("a", 1, "D", 40.0), ("z", 1, "R", 33.0)], "unit STRING, year INT, party STRING, avg_poll DOUBLE")
    economy = spark.createDataFrame([("a", 1, 7.0), ("b", 1, 8.0)], "unit STRING, year INT, q2 DOUBLE")
    returns = spark.createDataFrame(
        [("a", 1, "D", 51.0, 52.0, 50.0, 52.0, 48.0), ("b", 1, "R", 45.0, 47.0, 49.0, 53.0, 47.0)],
        "unit STRING, year INT, party STRING, pv DOUBLE, pv2p DOUBLE, lag_pv2p DOUBLE, d_pv2p DOUBLE, r_pv2p DOUBLE",
    )
    office = spark.createDataFrame([(1, "R")], "year INT, in_office STRING")
    people = spark.createDataFrame([("a", 1, 0.5)], "unit STRING, year INT, segment_chng DOUBLE")
    got = by(assemble_features(polls, economy, returns, office, people), "unit")
    assert len(got) == 3
    assert got["a",]["avg_poll"] == 40.0 and got["b",]["avg_poll"] == 45.0
    assert got["z",]["pv"] is None and got["z",]["q2"] is None
    assert got["a",]["inc_party"] == "R" and got["a",]["inc_pv"] == 48.0 and got["a",]["chl_pv"] == 52.0


def test_histogram_bins(spark):
    rows = [("a", float(v)) for v in range(11)] + [("flat", 3.0), ("flat", 3.0), ("a", None)]
    got = by(histogram(spark.createDataFrame(rows, "f STRING, v DOUBLE"), ["f"], "v", 5), "f", "bin")
    assert [got["a", b]["rows"] for b in range(1, 6)] == [2, 2, 2, 2, 3]
    assert got["flat", 1]["rows"] == 2 and got["flat", 1]["bin_to"] == 3.0
    assert got["a", 5]["bin_to"] == 10.0


def test_national_tables_come_from_the_written_panel(spark, small):
    """The monthly panel is the one scan of the orders."""
    monthly = domain.cut_lineage(domain.monthly_panel(spark, small))
    for df in (domain.quarterly_growth(monthly), domain.national_conditions(monthly)):
        assert "orders.parquet" not in "".join(df.inputFiles())
        assert df.count() > 0


def test_strongest_units_shuffle_the_orders_once(spark, small):
    plan = domain.subunit_totals(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
