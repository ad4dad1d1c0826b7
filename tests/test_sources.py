"""Readers, tolerant cleaning, dates, overrides, quantiles."""

import math

import pytest
from panelcast.functions import cleaning as C
from panelcast.functions.shares import challenger_party, incumbent_party, side_value
from panelcast.functions.student import quantile_table, t_p_value, t_quantile
from panelcast.operators.polls import combine_means, partial_means, recent_polls, tier_blend, tier_of
from panelcast.session import ensure_checkpoint_dir, small_side
from panelcast.sources.inline import DEFAULT_TIER, GRADE_TIERS, TIER_WEIGHTS, broadcast_inline
from panelcast.sources.readers import read_feed, read_padded_csv, read_source
from pyspark.sql import functions as F


def write(path, text):
    path.write_text(text)
    return str(path)


def test_typed_csv(spark, tmp_path):
    path = write(
        tmp_path / "n.csv",
        "year,party,winner,candidate,pv,pv2p,incumbent,incumbent_party,prev_admin,extra\n"
        '2000,democrat,FALSE,"Doe, Jane",48.3,NA,FALSE,TRUE,FALSE,1\n'
        "2004,republican,TRUE,NA,50.7,51.2,TRUE,TRUE,FALSE,2\n",
    )
    rows = read_source(spark, "national_returns", path).orderBy("year").collect()
    assert rows[0]["candidate"] == "Doe, Jane" and rows[0]["pv2p"] is None
    assert rows[1]["candidate"] is None and rows[1]["winner"] is True and rows[1]["pv2p"] == 51.2
    assert "extra" not in rows[0]


def test_missing_columns_are_reported(spark, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        read_source(spark, "economy", write(tmp_path / "e.csv", "year,quarter\n2000,2\n"))


def test_feed_reads_every_file_of_a_glob(spark, tmp_path):
    head = "state,candidate_name,fte_grade,pct,start_date,end_date\n"
    write(tmp_path / "p1.csv", head + "Ohio,X,A,45.5,9/1/20,9/3/20\n")
    write(tmp_path / "p2.csv", head + "NA,Y,B,44,9/1/20,9/3/20\n")
    rows = read_feed(spark, str(tmp_path / "p*.csv")).orderBy("pct").collect()
    assert [r["state"] for r in rows] == [None, "Ohio"]


def test_each_file_of_a_feed_is_read_by_its_own_header(spark, tmp_path):
    write(tmp_path / "p1.csv", "state,candidate_name,fte_grade,pct,start_date,end_date\nOhio,X,A,45.5,9/1/20,9/3/20\n")
    write(tmp_path / "p2.csv", "note,candidate_name,state,pct,fte_grade,end_date,start_date\nn,Y,Iowa,44,B,9/3/20,9/1/20\n")
    write(tmp_path / "p3.csv", "state,candidate_name,fte_grade,pct,start_date,end_date\nUtah,Z,C,43,9/1/20,9/3/20\n")
    rows = read_feed(spark, str(tmp_path / "p*.csv")).orderBy("pct").collect()
    assert [(r["state"], r["candidate_name"], r["fte_grade"]) for r in rows] == [("Utah", "Z", "C"), ("Iowa", "Y", "B"), ("Ohio", "X", "A")]
    assert "note" not in rows[0]
    listed = read_source(spark, "poll_feed", [str(tmp_path / "p2.csv"), str(tmp_path / "p3.csv")])
    assert {r["state"] for r in listed.collect()} == {"Iowa", "Utah"}


def test_padding_around_a_table_is_dropped(spark, tmp_path):
    path = write(
        tmp_path / "r.csv",
        "Quarterly income\nBureau\n\nUnits: millions\nId,Name,1948:Q1,1948:Q2\n"
        '"01",Alabama,100,101\n"02",Alaska *,(NA),55\n'
        "Legend\n(NA) not available\n* since 1950\nnote\nend\n",
    )
    df = read_padded_csv(spark, path, ["id", "name", "q1", "q2"], ["q1", "q2"])
    rows = sorted(map(tuple, df.collect()))
    assert rows == [("01", "Alabama", "100", "101"), ("02", "Alaska *", "(NA)", "55")]


def test_snake_case_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Age 20", "StateName", "538 Grade", "age.20"])
    assert C.clean_names(df).columns == ["age_20", "state_name", "538_grade", "age_20_2"]


def test_tolerant_numbers(spark):
    df = spark.createDataFrame([("1,234",), ("(NA)",), (" 12 ",), ("",), ("3.5",), (None,)], "t STRING")
    got = [r[0] for r in df.select(C.to_number("t")).collect()]
    assert got == [None, None, 12.0, None, 3.5, None]
    kept = C.drop_subheader(df, ["t"]).count()
    assert kept == 2


def test_short_dates_and_time_left(spark):
    df = spark.createDataFrame([("9/3/20",), ("10/25/20",), ("soon",), ("11/9/20",)], "t STRING")
    event = F.lit("2020-11-03").cast("date")
    on = C.parse_short_date("t")
    got = df.select(on.cast("string"), C.days_left(event, on), C.weeks_left(event, on)).collect()
    assert [tuple(r) for r in got] == [
        ("2020-09-03", 61, 9),
        ("2020-10-25", 9, 1),
        (None, None, None),
        ("2020-11-09", -6, -1),
    ]


def test_override_named_keys(spark):
    df = spark.createDataFrame([("a", "x *"), ("b", "y"), ("c", None)], "k STRING, v STRING")
    fix = spark.createDataFrame([("a", "x")], "k STRING, v STRING")
    got = {r["k"]: r["v"] for r in C.override_values(df, fix, "k", "v").collect()}
    assert got == {"a": "x", "b": "y", "c": None}


def test_polls_edge(spark):
    rows = [
        ("Ohio", "X", 45.0, "10/30/20"),
        ("Ohio", "X", 47.0, "10/25/20"),
        ("Ohio", "X", 10.0, "9/1/20"),
        (None, "X", 99.0, "10/30/20"),
        ("Ohio", "Other", 1.0, "10/30/20"),
        ("Ohio", "Y", 50.0, "11/20/20"),
    ]
    polls = spark.createDataFrame(rows, "state STRING, cand STRING, pct DOUBLE, ended STRING")
    recent = recent_polls(
        polls,
        F.lit("2020-11-03").cast("date"),
        C.parse_short_date("ended"),
        "state",
        "cand",
        {"X": "D", "Y": "R"},
        2,
    )
    means = combine_means(partial_means(recent, ["state", "party", "weeks_left"], "pct"), ["party"], "m")
    assert {r["party"]: (r["m"], r["polls"]) for r in means.collect()} == {"D": (46.0, 2), "R": (50.0, 1)}


def test_tiers(spark):
    rows = [("X", "A+", 50.0), ("X", "A", 40.0), ("X", "B/C", 30.0), ("X", "D", 20.0), ("X", None, 10.0), ("Y", "A", 9.0)]
    polls = spark.createDataFrame(rows, "party STRING, grade STRING, pct DOUBLE")
    tiers = broadcast_inline(spark, GRADE_TIERS, "grade STRING, tier STRING")
    tiered = tier_of("grade", tiers, polls, DEFAULT_TIER)
    out = tier_blend(partial_means(tiered, ["party", "tier"], "pct"), ["party"], TIER_WEIGHTS, "w")
    got = {r["party"]: r for r in out.collect()}
    assert (got["X"]["tier_a"], got["X"]["tier_b"], got["X"]["tier_low"]) == (45.0, 30.0, 15.0)
    assert got["X"]["w"] == pytest.approx(0.5 * 45 + 0.3 * 30 + 0.2 * 15)
    assert got["Y"]["w"] is None


# Published two-sided 95 % quantiles of the t distribution.
T_95 = {1: 12.7062047362, 2: 4.3026527297, 6: 2.4469118511, 10: 2.2281388520, 30: 2.0422724563, 100: 1.9839715185}


def test_t_quantiles(spark):
    for df, value in T_95.items():
        assert math.isclose(quantile_table()[df - 1], value, rel_tol=1e-9)
    rows = spark.createDataFrame([(d,) for d in (0, 1, 6, 200, 201, 1000)], "d BIGINT")
    got = [r[0] for r in rows.selectExpr(f"{t_quantile('d')} AS t").collect()]
    assert got[0] is None
    assert math.isclose(got[1], T_95[1], rel_tol=1e-9) and math.isclose(got[2], T_95[6], rel_tol=1e-9)
    assert math.isclose(got[4], 1.9718366, rel_tol=1e-6) and math.isclose(got[5], 1.9623390808, rel_tol=1e-8)
    assert got[3] > got[4] > got[5]


def test_p_value_of_the_quantile_is_the_level(spark):
    rows = spark.createDataFrame([(t, float(d)) for d, t in T_95.items()] + [(None, 3.0), (1.0, 0.0)], "t DOUBLE, d DOUBLE")
    got = [r[0] for r in rows.select(t_p_value("t", "d")).collect()]
    assert all(math.isclose(p, 0.05, rel_tol=1e-8) for p in got[:-2]) and got[-2:] == [None, None]


def test_small_side_is_checked(spark):
    df = spark.range(50)
    assert "broadcast" in small_side(df, 50)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in small_side(df, 49)._jdf.queryExecution().analyzed().toString().lower()
    assert ensure_checkpoint_dir(spark)


# Two-party share of the party in office in 18 national elections.
OFFICE_SHARES = [
    (1948, "D", 52.31764025, True),
    (1952, "D", 44.71055631, False),
    (1956, "R", 57.76433968, True),
    (1960, "R", 49.91324051, False),
    (1964, "D", 61.34396784, True),
    (1968, "D", 49.59537839, False),
    (1972, "R", 61.78900883, True),
    (1976, "R", 48.86265083, False),
    (1980, "D", 44.84244123, False),
    (1984, "R", 59.12335119, True),
    (1988, "R", 53.83245529, True),
    (1992, "R", 46.37930416, False),
    (1996, "D", 54.80402403, True),
    (2000, "D", 50.25952345, False),
    (2004, "R", 51.26931596, True),
    (2008, "R", 46.22923272, False),
    (2012, "D", 51.91525804, True),
    (2016, "D", 51.16249044, False),
]


def test_mean_share_in_and_out_of_office(spark):
    df = spark.createDataFrame(OFFICE_SHARES, "year INT, party STRING, pv2p DOUBLE, winner BOOLEAN")
    sides = df.withColumns(
        {
            "incumbent": F.lit(True),
            "d": F.when(F.col("party") == "D", F.col("pv2p")).otherwise(100.0 - F.col("pv2p")),
        }
    ).withColumn("r", 100.0 - F.col("d"))
    row = sides.agg(
        F.avg(side_value(incumbent_party("party", "incumbent"), "d", "r")).alias("inside"),
        F.avg(side_value(challenger_party("party", "incumbent"), "d", "r")).alias("outside"),
        F.count_if("winner").alias("wins"),
    ).first()
    assert math.isclose(row["inside"], 52.006343286, rel_tol=1e-9)
    assert math.isclose(row["outside"], 47.993656714, rel_tol=1e-9)
    assert row["wins"] == 9
