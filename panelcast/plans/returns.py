"""Returns, shares, labels, swings, polarization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.cleaning import fill_from, numeric_columns, round_columns
from panelcast.functions.shares import lean, two_party_margin, winner, winner_or_second
from panelcast.operators.exact import exact_sums
from panelcast.operators.histogram import doubling_histogram
from panelcast.operators.ordered import lag_any_length
from panelcast.operators.panel import (
    assemble_features,
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
from panelcast.operators.skew import split_join
from panelcast.plans import domain
from panelcast.session import cut_lineage
from panelcast.sources.inline import broadcast_inline
from panelcast.sources.readers import table

CLOSE = 5.0
# The periods that the literal table names.
LABELLED_YEARS = range(1995, 2002)


def returns_scan(spark: SparkSession, folder: str) -> DataFrame:
    return round_columns(domain.unit_returns(spark, folder), 2)


def shares(spark: SparkSession, folder: str) -> DataFrame:
    df = domain.unit_shares(spark, folder).withColumn("d_margin", two_party_margin("d", "r"))
    kept = df.filter((F.col("total") > 0) & F.col("year").isNotNull())
    return round_columns(kept.drop("trials", "d_count", "r_count", "d", "r", "total"))


def winner_labels(spark: SparkSession, folder: str) -> DataFrame:
    return domain.unit_returns(spark, folder).select(
        "unit",
        "year",
        winner_or_second("d", "r", "D", "R").alias("winner_default"),
        winner("d", "r").alias("winner"),
    )


def two_period_swing(spark: SparkSession, folder: str) -> DataFrame:
    """Change between two periods in the units that were within ten points in the later one."""
    _, now = domain.periods(spark, folder)
    first, last = now - 2, now - 1
    units = period_columns(
        domain.unit_shares(spark, folder), ["unit"], "year", "d_pv2p", {first: "d_first", last: "d_last"}
    )
    swing = units.withColumns(
        {
            "swing": F.col("d_last") - F.col("d_first"),
            "lead": F.lit(100.0) - F.col("d_last") - F.col("d_last"),
        }
    )
    return round_columns(swing.filter(F.col("lead").between(-10.0, 10.0)))


def close_units(spark: SparkSession, folder: str) -> DataFrame:
    df = domain.unit_returns(spark, folder).withColumn("margin", F.abs(two_party_margin("d", "r")))
    return round_columns(df.filter(F.col("margin") <= CLOSE).select("unit", "year", "margin"))


def battlegrounds_per_year(spark: SparkSession, folder: str) -> DataFrame:
    """Mean number of close units per period and era; the last period arrives as fractions."""
    _, last = domain.periods(spark, folder)
    scale = F.when(F.col("year") == last, 0.01).otherwise(1.0)
    mixed = domain.unit_shares(spark, folder).select(
        "unit", "year", (F.col("d_pv2p") * scale).alias("d_share"), (F.col("r_pv2p") * scale).alias("r_share")
    )
    fractions = mixed.filter(F.col("year") == last).withColumns(
        {"d_share": F.col("d_share") * 100.0, "r_share": F.col("r_share") * 100.0}
    )
    percents = mixed.filter(F.col("year") != last)
    close = percents.unionByName(fractions).filter(
        F.abs(F.col("d_share") - F.col("r_share")) <= CLOSE
    )
    per_year = close.groupBy("year").agg(F.count(F.lit(1)).alias("close_units"))
    era = F.when(F.col("year") <= 1998, "early").otherwise("late").alias("era")
    return round_columns(
        per_year.groupBy(era).agg(
            F.avg("close_units").alias("mean_close"), F.count(F.lit(1)).alias("years")
        )
    )


def _subunit_margins(spark: SparkSession, folder: str) -> DataFrame:
    return domain.subunit_returns(spark, folder).select(
        "subunit", "year", two_party_margin("d", "r").alias("margin")
    )


def panel_lags(spark: SparkSession, folder: str) -> DataFrame:
    """Lags by row of the sub-unit; the first period is dropped only after the window."""
    df = lag_columns(
        _subunit_margins(spark, folder),
        ["subunit"],
        "year",
        {"lag_margin": ("margin", 1), "lag5_margin": ("margin", 5), "lead2_margin": ("margin", -2)},
    )
    df = df.withColumn("shift", F.col("margin") - F.col("lag_margin"))
    first, _ = domain.periods(spark, folder)
    return round_columns(df.filter(F.col("year") > first))


def loyal_units_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Mean change of margin in sub-units with the same lean in the first and last period."""
    first, last = domain.periods(spark, folder)
    ends = period_columns(
        _subunit_margins(spark, folder),
        ["subunit"],
        "year",
        "margin",
        {first: "first_margin", last: "last_margin"},
    )
    loyal = ends.withColumn("lean", lean("first_margin")).filter(
        F.col("lean") == lean("last_margin")
    )
    return round_columns(
        loyal.groupBy("lean").agg(
            F.avg(F.col("last_margin") - F.col("first_margin")).alias("mean_shift"),
            F.count(F.lit(1)).alias("subunits"),
        )
    )


def polarization_table(spark: SparkSession, folder: str) -> DataFrame:
    """Per period: mean margin and mean shift on either side, and the gap between them."""
    df = change_columns(
        _subunit_margins(spark, folder), ["subunit"], "year", {"shift": ("margin", 1)}
    ).withColumn("lean", lean("margin"))

    def mean_in(side: str, c: str):
        return F.avg(F.when(F.col("lean") == side, F.col(c)))

    out = df.groupBy("year").agg(
        mean_in("R", "shift").alias("shift_r"),
        mean_in("D", "shift").alias("shift_d"),
        mean_in("R", "margin").alias("margin_r"),
        mean_in("D", "margin").alias("margin_d"),
    )
    return round_columns(out.withColumn("gap", F.col("margin_d") - F.col("margin_r")))


def demographic_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Segment shares and their changes, all over one window."""
    names = {f"{s.lower()}_chng": (s.lower(), 1) for s in domain.SEGMENTS}
    return round_columns(
        change_columns(domain.segment_shares(spark, folder), ["unit"], "year", names)
    )


def unit_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Unit to code and back, and the class of its region."""
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    classes = broadcast_inline(spark, domain.REGION_CLASSES, "r_name STRING, class STRING")
    region_classes = regions.join(classes, "r_name", "left").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"), "class"
    )
    coded = nations.join(region_classes, "n_regionkey", "left")
    customers = (
        table(spark, folder, "customer")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count(F.lit(1)).alias("subunits"))
    )
    return customers.join(coded, "n_nationkey", "left").select(
        F.col("n_name").alias("unit"), F.col("n_nationkey").alias("code"), "region", "class", "subunits"
    )


def membership_filters(spark: SparkSession, folder: str) -> DataFrame:
    df = domain.unit_returns(spark, folder).select(
        "unit", "year", two_party_margin("d", "r").alias("margin")
    )
    return round_columns(members(df, domain.battlegrounds(spark), ["unit"], "membership"))


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """The model input assembled from separate poll, economy, returns and demographic tables."""
    monthly = cut_lineage(domain.monthly_panel(spark, folder))
    yearly = domain.yearly_panel(monthly)
    in_office = domain.incumbents(yearly)
    rows = domain.features_from(yearly, in_office)
    polls = rows.filter(F.col("avg_poll").isNotNull()).select("unit", "year", "party", "avg_poll")
    economy = (
        monthly.filter(F.col("month").between(4, 6))
        .groupBy("unit", "year")
        .agg(F.sum("total").alias("value_q2"))
    )
    returns = rows.select("unit", "year", "party", "pv", "pv2p", "lag_pv2p").join(
        yearly.select("unit", "year", "d_pv2p", "r_pv2p"), ["unit", "year"]
    )
    demographics = change_columns(
        yearly.select("unit", "year", "building"), ["unit"], "year", {"segment_chng": ("building", 1)}
    ).drop("building")
    out = assemble_features(polls, economy, returns, in_office, demographics)
    return round_columns(out.drop("in_office", "is_incumbent", "d_pv2p", "r_pv2p")).withColumn(
        "value_q2", F.round("value_q2", 2)
    )


def wide_to_long_series(spark: SparkSession, folder: str) -> DataFrame:
    """One text column per year turned into rows, cast tolerantly, every second period kept."""
    second_quarter = (
        domain.monthly_values(spark, folder)
        .filter(F.col("month").between(4, 6))
        .groupBy(F.col("c_nationkey").alias("unit_id"), "year")
        .agg(F.round(F.sum("total"), 2).alias("value"))
    )
    first, last = domain.periods(spark, folder)
    names = {y: f"value_{y}" for y in range(first, last + 1)}
    wide = period_columns(second_quarter, ["unit_id"], "year", "value", names)
    text = wide.select(
        "unit_id", *[fill_from(F.col(c).cast("string"), F.lit("(NA)")).alias(c) for c in names.values()]
    )
    numbers = numeric_columns(text, list(names.values()))
    periods = {c: int(c.rsplit("_", 1)[1]) for c in names.values()}
    long = wide_to_long(numbers, ["unit_id"], periods, "year", "value_q2")
    named = every_kth(long, "year", 2, first).join(
        domain.nation_names(spark, folder), "unit_id"
    )
    return round_columns(named.select("unit", "year", "value_q2"), 2)


def inline_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """National shares with a literal table of period labels; periods it does not name have NULLs."""
    labels = broadcast_inline(
        spark,
        [(y, "early" if y <= 1998 else "late", 0.5 if y <= 1998 else 1.0) for y in LABELLED_YEARS],
        "year INT, era STRING, weight DOUBLE",
    )
    national = domain.national_shares(domain.unit_returns(spark, folder))
    out = national.join(labels, "year", "left").withColumn("weighted", F.col("d_pv2p") * F.col("weight"))
    return round_columns(out.select("year", "era", "weight", "d_pv2p", "weighted"))


def incumbent_side(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the side in office, kept by a semi-join on period and side."""
    yearly = cut_lineage(domain.yearly_panel(domain.monthly_panel(spark, folder)))
    in_office = domain.incumbents(yearly).filter(F.col("in_office").isNotNull())
    rows = domain.features_from(yearly, in_office)
    held = in_office.select("year", F.col("in_office").alias("party"))
    kept = rows.join(held, ["year", "party"], "left_semi")
    return round_columns(kept.select("unit", "year", "party", "pv", "pv2p"))


def first_approval_join(spark: SparkSession, folder: str) -> DataFrame:
    """First reading per rater and day, joined to rater and unit."""
    events = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "value", F.to_date("ts").alias("day")
    )
    first = first_row(events, ["user_id", "day"], ["ts", "event_id"], ["value", "event_id"])
    raters = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_nationkey", F.col("c_mktsegment").alias("segment")
    )
    return (
        first.join(raters, "user_id", "inner")
        .join(domain.nation_names(spark, folder), F.col("c_nationkey") == F.col("unit_id"), "inner")
        .select(
            F.col("user_id").alias("rater"),
            F.date_format("day", "yyyy-MM-dd").alias("day"),
            F.round(F.col("value") - 50.0, 6).alias("net_approve"),
            "segment",
            "unit",
        )
    )


def turnout_range(spark: SparkSession, folder: str) -> DataFrame:
    """Lowest, highest and mean turnout of every unit over the periods."""
    returns = domain.unit_returns(spark, folder)
    votes = returns.select("unit", "year", (F.col("d_count") + F.col("r_count")).alias("votes"))
    eligible = returns.select("unit", "year", "trials")
    turnout = natural_join(votes, eligible).withColumn(
        "turnout", F.try_divide(F.col("votes").cast("double"), F.col("trials").cast("double"))
    )
    return round_columns(
        turnout.groupBy("unit").agg(
            F.min("turnout").alias("min_turnout"),
            F.max("turnout").alias("max_turnout"),
            F.avg("turnout").alias("mean_turnout"),
        )
    )


def strongest_units(spark: SparkSession, folder: str) -> DataFrame:
    """The ten strongest sub-units of either side over all periods."""
    totals = (
        domain.subunit_totals(spark, folder)
        .select("subunit", F.round(two_party_margin("d", "r"), 6).alias("margin"))
        .filter(F.col("margin").isNotNull())
    )
    return strongest(totals, "margin", 10, ["subunit"])


def ranked_units(spark: SparkSession, folder: str) -> DataFrame:
    """Position of every sub-unit in the order of its overall margin."""
    totals = (
        domain.subunit_totals(spark, folder)
        .select("subunit", F.round(two_party_margin("d", "r"), 6).alias("margin"))
        .filter(F.col("margin").isNotNull())
    )
    return order_index(totals, ["margin", "subunit"])


def order_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Every order next to the one before it, in the whole table and of its customer, by date and number."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    order = ["o_orderdate", "o_orderkey"]
    rows = lag_any_length(orders, [], order, {"last_date": ("o_orderdate", 1), "last_price": ("o_totalprice", 1)})
    rows = lag_any_length(rows, ["o_custkey"], order, {"own_date": ("o_orderdate", 1), "third_price": ("o_totalprice", 3)})
    return rows.select(
        "o_orderkey",
        F.datediff("o_orderdate", "last_date").alias("days_since_last"),
        F.round(F.col("o_totalprice") - F.col("last_price"), 2).alias("price_change"),
        F.datediff("o_orderdate", "own_date").alias("days_since_own"),
        F.round(F.col("o_totalprice") - F.col("third_price"), 2).alias("price_change_3"),
    )


def graded_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per grade of their customer and status, every order joined to its customer."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    grades = broadcast_inline(spark, domain.SEGMENT_GRADES, "c_mktsegment STRING, grade STRING")
    rows = split_join(orders, customers, ["c_custkey"], "left").join(grades, "c_mktsegment", "left")
    return round_columns(
        rows.groupBy("grade", F.col("o_orderstatus").alias("status")).agg(
            F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"), F.avg("o_totalprice").alias("mean_price")
        ),
        2,
    )


def exact_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Value of all orders per year and status, to the last bit whatever the order of the rows."""
    orders = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value")
    )
    sums = exact_sums(orders, ["year", "status"], ["value"])
    return sums.withColumn("value_mean", F.col("value_sum") / F.col("value_n"))


def price_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of order values per status, at most 64 bins of the least power of two as width."""
    return doubling_histogram(table(spark, folder, "orders"), ["o_orderstatus"], "o_totalprice", 64)


QUERIES = {
    f.__name__: f
    for f in (
        returns_scan,
        shares,
        winner_labels,
        two_period_swing,
        close_units,
        battlegrounds_per_year,
        panel_lags,
        loyal_units_shift,
        polarization_table,
        demographic_deltas,
        unit_classes,
        membership_filters,
        feature_table,
        wide_to_long_series,
        inline_dimension,
        incumbent_side,
        first_approval_join,
        turnout_range,
        strongest_units,
        ranked_units,
        order_gaps,
        graded_orders,
        exact_totals,
        price_histogram,
    )
}
