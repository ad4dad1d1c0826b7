"""The forecasting concepts as views over the order tables.

A unit is a nation, a sub-unit a customer, a period an order year. Order value by
status 'F'/'O'/'P' stands for votes of side D, side R and others; order counts for
turnout. Monthly status shares are the historical polls, events are the live poll
feed, and value shares by market segment are the demographic series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.shares import DEMOCRAT, REPUBLICAN, share_of, two_party_share, winner
from panelcast.operators.panel import change_columns, lag_columns
from panelcast.session import cut_lineage, small_side
from panelcast.sources.inline import broadcast_inline
from panelcast.sources.readers import table

# Thresholds of the registered queries.
POLL_WEEKS = 26
EVENT_DATE = "2024-02-01"
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# Which live-feed event stands for which side.
EVENT_PARTIES = {"click": DEMOCRAT, "purchase": REPUBLICAN}

# Pollster grade by market segment.
SEGMENT_GRADES = [
    ("AUTOMOBILE", "A"),
    ("BUILDING", "B+"),
    ("FURNITURE", "B/C"),
    ("HOUSEHOLD", "C"),
    ("MACHINERY", "D"),
]

# Class of each region's units.
REGION_CLASSES = [
    ("AFRICA", "Blue"),
    ("AMERICA", "Swing"),
    ("ASIA", "Red"),
    ("EUROPE", "Blue"),
    ("MIDDLE EAST", "Sun Swing"),
]

# Units that get special attention in the error tables.
BATTLEGROUNDS = [
    "NATION_1",
    "NATION_4",
    "NATION_6",
    "NATION_9",
    "NATION_11",
    "NATION_14",
    "NATION_16",
    "NATION_19",
    "NATION_21",
    "NATION_24",
]


# Votes and turnout of a group of orders.
_VOTES = [
    "sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS d",
    "sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS r",
    "sum(o_totalprice) AS total",
    "count(*) AS trials",
    "count_if(o_orderstatus = 'F') AS d_count",
    "count_if(o_orderstatus = 'O') AS r_count",
]
_VOTE_SUMS = [f"sum({c}) AS {c}" for c in ("d", "r", "total", "trials", "d_count", "r_count")]
_SEGMENT_VALUES = [
    f"sum(CASE WHEN c_mktsegment = '{s}' THEN total ELSE 0D END) AS {s.lower()}"
    for s in SEGMENTS
]

_SUBUNIT_VOTES = [
    f"sum(CASE WHEN o_orderstatus = '{status}' THEN o_totalprice ELSE 0D END) AS {name}"
    for status, name in (("F", "d"), ("O", "r"))
]


def _aggregates(texts: Sequence[str]) -> list[Column]:
    return [F.expr(t) for t in texts]


def periods(spark: SparkSession, folder: str) -> tuple[int, int]:
    """First and last year of the orders; both 0 where there are none."""
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"))
    first, last = years.agg(F.min("year"), F.max("year")).first()
    return first or 0, last or 0


def last_period(rows: DataFrame) -> int:
    """Last year of a written panel; 0 where there is none."""
    return rows.agg(F.max("year")).first()[0] or 0


def monthly_values(spark: SparkSession, folder: str) -> DataFrame:
    """Votes and turnout by month and the customer's nation and segment.

    Orders are summed per customer and month before they meet their customer, so a customer with any
    share of the orders is a few rows in the join.
    """
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    summed = orders.groupBy(
        "o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    ).agg(*_aggregates(_VOTES))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return summed.join(customers, summed.o_custkey == customers.c_custkey)


def nation_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("unit")
    )


def unit_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Votes and turnout per unit and year; a side without votes is NULL."""
    grouped = (
        monthly_values(spark, folder)
        .groupBy(F.col("c_nationkey").alias("unit_id"), "year")
        .agg(*_aggregates(_VOTE_SUMS))
    )
    return grouped.join(nation_names(spark, folder), "unit_id").drop("unit_id")


def segment_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each market segment in a unit's value, per year."""
    grouped = (
        monthly_values(spark, folder)
        .groupBy(F.col("c_nationkey").alias("unit_id"), "year")
        .agg(*_aggregates(["sum(total) AS total", *_SEGMENT_VALUES]))
        .join(nation_names(spark, folder), "unit_id")
    )
    return grouped.select("unit", "year", *[share_of(s.lower(), "total").alias(s.lower()) for s in SEGMENTS])


def unit_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Returns with shares of total and two-party shares."""
    return with_shares(unit_returns(spark, folder))


def with_shares(returns: DataFrame) -> DataFrame:
    return returns.withColumns(
        {
            "d_pv": share_of("d", "total"),
            "r_pv": share_of("r", "total"),
            "d_pv2p": two_party_share("d", "r"),
            "r_pv2p": two_party_share("r", "d"),
        }
    )


def subunit_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Votes per sub-unit and year, one shuffle and no join; a side without votes has zero."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("subunit"), F.year("o_orderdate").alias("year"))
        .agg(*_aggregates(_SUBUNIT_VOTES))
    )


def subunit_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Votes per sub-unit over all years, one shuffle."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(F.col("o_custkey").alias("subunit")).agg(*_aggregates(_SUBUNIT_VOTES))


def monthly_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Everything the models need, per unit, year and month, from one scan of the orders."""
    grouped = (
        monthly_values(spark, folder)
        .groupBy(F.col("c_nationkey").alias("unit_id"), "year", "month")
        .agg(*_aggregates([*_VOTE_SUMS, *_SEGMENT_VALUES]))
    )
    return grouped.join(nation_names(spark, folder), "unit_id").drop("unit_id")


def late_poll(count: str, name: str) -> str:
    """Mean over the year's late months of the side's share of that month's orders."""
    days = "datediff(make_date(year, 12, 31), last_day(make_date(year, month, 1)))"
    return (
        f"avg(CASE WHEN round({days} / 7.0D) <= {POLL_WEEKS}"
        f" THEN try_divide({count} * 100D, trials) END) AS {name}"
    )


def yearly_panel(monthly: DataFrame) -> DataFrame:
    """Returns, shares, late polls and segment shares per unit and year."""
    names = [s.lower() for s in SEGMENTS]
    sums = ["d", "r", "total", "trials", "d_count", "r_count"]
    yearly = monthly.groupBy("unit", "year").agg(
        *_aggregates(
            [
                *[f"sum({c}) AS {c}" for c in sums],
                *[f"try_divide(sum({s}) * 100D, sum(total)) AS {s}" for s in names],
                late_poll("d_count", "d_poll"),
                late_poll("r_count", "r_poll"),
            ]
        )
    )
    return with_shares(yearly)


def incumbents(returns: DataFrame) -> DataFrame:
    """Party in office in each year: the side that won the whole country the year before."""
    national = returns.groupBy("year").agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
    return national.select(
        (F.col("year") + 1).alias("year"), winner("d", "r").alias("in_office")
    )


def features_from(yearly: DataFrame, in_office: DataFrame) -> DataFrame:
    """One row per unit, year and side with response, predictors and turnout."""
    # joined first: the window then leaves rows partitioned by unit, which is all the
    # per-unit fits need, so they add no shuffle of their own
    panel = yearly.join(small_side(in_office), "year", "left")
    panel = lag_columns(
        panel, ["unit"], "year", {"lag_d_pv2p": ("d_pv2p", 1), "lag_r_pv2p": ("r_pv2p", 1)}
    )
    panel = change_columns(panel, ["unit"], "year", {"segment_chng": ("building", 1)})
    sides = ", ".join(
        f"'{party}', {s}_pv, {s}_pv2p, lag_{s}_pv2p, segment_chng,"
        f" CAST(in_office = '{party}' AS DOUBLE), {s}_poll, {s}_count, trials"
        for s, party in (("d", DEMOCRAT), ("r", REPUBLICAN))
    )
    names = "party, pv, pv2p, lag_pv2p, segment_chng, incumbent_party, avg_poll, successes, trials"
    return panel.selectExpr(
        "unit", "year", f"stack(2, {sides}) AS ({names})"
    )


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The model input. The yearly panel is written once because several steps read it.

    The office table has one row per period; it is counted before it is broadcast.
    """
    yearly = cut_lineage(yearly_panel(monthly_panel(spark, folder)))
    return features_from(yearly, incumbents(yearly))


def train_and_score(features: DataFrame, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Earlier periods to fit on, one period to predict: the last one of the features unless it is named."""
    year = last_period(features) if year is None else year
    return features.filter(F.col("year") < year), features.filter(F.col("year") == year)


def actual_shares(features: DataFrame) -> DataFrame:
    """Actual shares of total by unit and year, sides side by side."""
    return features.groupBy("unit", "year").agg(
        F.max(F.when(F.col("party") == DEMOCRAT, F.col("pv"))).alias("d_actual"),
        F.max(F.when(F.col("party") == REPUBLICAN, F.col("pv"))).alias("r_actual"),
    )


def unit_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of each unit: three plus a tenth of its customers, keyed, not positional."""
    counts = (
        table(spark, folder, "customer")
        .groupBy(F.col("c_nationkey").alias("unit_id"))
        .agg((F.lit(3) + F.floor(F.count(F.lit(1)) / 10)).cast("long").alias("ev"))
    )
    return counts.join(nation_names(spark, folder), "unit_id").select("unit", "ev")


def battlegrounds(spark: SparkSession) -> DataFrame:
    return broadcast_inline(
        spark, [(u, True) for u in BATTLEGROUNDS], "unit STRING, is_battleground BOOLEAN"
    )


def quarterly_growth(monthly: DataFrame) -> DataFrame:
    """National value per quarter and its growth on the quarter before, from the monthly panel.

    The previous quarter is found by key, so no window spans the whole series.
    """
    quarters = (
        monthly.groupBy("year", F.ceil(F.col("month") / 3).cast("int").alias("quarter"))
        .agg(F.sum("total").alias("value"))
        .withColumn("at", F.col("year") * 4 + F.col("quarter"))
    )
    before = quarters.select((F.col("at") + 1).alias("at"), F.col("value").alias("previous"))
    return quarters.join(before, "at", "left").select(
        "year",
        "quarter",
        "value",
        F.try_divide((F.col("value") - F.col("previous")) * 100.0, F.col("previous")).alias("growth"),
    )


def national_shares(returns: DataFrame) -> DataFrame:
    """National two-party shares per year."""
    return (
        returns.groupBy("year")
        .agg(F.sum("d").alias("d"), F.sum("r").alias("r"))
        .withColumns({"d_pv2p": two_party_share("d", "r"), "r_pv2p": two_party_share("r", "d")})
    )


def national_conditions(monthly: DataFrame) -> DataFrame:
    """Per period: side in office, whether it was in office before, net approval, growth.

    Net approval is the late national support of the side in office minus that of the
    other; income growth compares a second quarter with the one a year earlier.
    """
    support = (
        monthly.groupBy("year", "month")
        .agg(*_aggregates([f"sum({c}) AS {c}" for c in ("d_count", "r_count", "trials")]))
        .groupBy("year")
        .agg(*_aggregates([late_poll("d_count", "d_support"), late_poll("r_count", "r_support")]))
    )
    office = incumbents(monthly)
    before = office.selectExpr("year + 1 AS year", "in_office AS before")
    quarters = quarterly_growth(monthly).filter(F.col("quarter") == 2)
    last_year = quarters.selectExpr("year + 1 AS year", "value AS earlier")
    growth = quarters.join(last_year, "year", "left").selectExpr(
        "year", "growth AS growth_q2", "try_divide((value - earlier) * 100D, earlier) AS income_growth"
    )
    net = "CASE in_office WHEN 'D' THEN d_support - r_support WHEN 'R' THEN r_support - d_support END"
    return (
        office.join(before, "year", "left")
        .join(support, "year", "left")
        .join(growth, "year", "left")
        .selectExpr(
            "year",
            "in_office",
            "in_office = before AS two_terms",
            f"{net} AS net_approve",
            "growth_q2",
            "income_growth",
        )
    )
