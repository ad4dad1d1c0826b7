"""Poll averages, grades and the poll-and-growth ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.cleaning import parse_short_date, round_columns
from panelcast.functions.shares import DEMOCRAT, REPUBLICAN, blend, side_value, strict_avg
from panelcast.operators.moments import Formula
from panelcast.operators.ols import ols_by_key, predict
from panelcast.operators.polls import (
    combine_means,
    exact_sum,
    label_values,
    mean_of_parts,
    partial_means,
    recent_polls,
    tier_blend,
    tier_of,
)
from panelcast.plans import domain
from panelcast.session import cut_lineage
from panelcast.sources.inline import (
    DEFAULT_TIER,
    GRADE_TIERS,
    GROWTH_WEIGHT,
    POLL_WEIGHT,
    TIER_WEIGHTS,
    broadcast_inline,
)
from panelcast.sources.readers import table


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    """The live poll feed: the end date arrives as short text."""
    return table(spark, folder, "events").select(
        "user_id",
        F.col("event_type").alias("candidate"),
        F.col("value").alias("pct"),
        F.date_format("ts", "M/d/yy").alias("end_date"),
    )


def recent_poll_average(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the polls of the last two weeks per unit and side.

    Polls are summed per rater before they meet the rater dimension, so a rater
    with a third of the feed is one row in the join.
    """
    polls = recent_polls(
        _feed(spark, folder),
        F.lit(domain.EVENT_DATE).cast("date"),
        parse_short_date("end_date"),
        "user_id",
        "candidate",
        domain.EVENT_PARTIES,
        2,
    )
    partial = polls.groupBy("user_id", "party").agg(
        exact_sum("pct").alias("part_sum"),
        F.count("pct").alias("part_rows"),
        F.min("days_left").alias("days_left"),
    )
    raters = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("unit_id")
    )
    homed = partial.join(raters, "user_id", "left").filter(F.col("unit_id").isNotNull())
    means = homed.groupBy("unit_id", "party").agg(
        mean_of_parts().alias("avg_pct"),
        F.sum("part_rows").alias("polls"),
        F.min("days_left").alias("min_days_left"),
    )
    named = means.join(domain.nation_names(spark, folder), "unit_id")
    return round_columns(named.select("unit", "party", "avg_pct", "polls", "min_days_left"))


def _tiered(spark: SparkSession, folder: str) -> DataFrame:
    """Partial poll sums per side and tier."""
    feed = _feed(spark, folder).withColumn("party", label_values("candidate", domain.EVENT_PARTIES))
    partial = partial_means(feed.filter(F.col("party").isNotNull()), ["user_id", "party"], "pct")
    raters = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_mktsegment"
    )
    grades = broadcast_inline(spark, domain.SEGMENT_GRADES, "c_mktsegment STRING, grade STRING")
    graded = partial.join(raters, "user_id", "left").join(grades, "c_mktsegment", "left")
    tiers = broadcast_inline(spark, GRADE_TIERS, "grade STRING, tier STRING")
    return tier_of("grade", tiers, graded, DEFAULT_TIER)


def grade_weighted_polls(spark: SparkSession, folder: str) -> DataFrame:
    return round_columns(tier_blend(_tiered(spark, folder), ["party"], TIER_WEIGHTS, "weighted_pct"))


def tier_averages(spark: SparkSession, folder: str) -> DataFrame:
    """The same tier means as rows."""
    return round_columns(combine_means(_tiered(spark, folder), ["party", "tier"], "avg_pct"))


def grade_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Raters per grade among those with a poll since mid-January."""
    latest = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").alias("latest"))
    active = latest.filter(F.col("latest") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    raters = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_mktsegment"
    )
    grades = broadcast_inline(spark, domain.SEGMENT_GRADES, "c_mktsegment STRING, grade STRING")
    return (
        active.join(raters, "user_id")
        .join(grades, "c_mktsegment")
        .groupBy("grade")
        .agg(F.count(F.lit(1)).alias("raters"))
    )


def _national_polls(monthly: DataFrame) -> DataFrame:
    """Late monthly polls of the whole country per period and side."""
    late = monthly.filter(F.col("month") >= 11)
    counts = late.groupBy("year", "month").agg(
        F.sum("d_count").alias("d"), F.sum("r_count").alias("r"), F.sum("trials").alias("n")
    )
    sides = F.array(
        F.struct(F.lit(DEMOCRAT).alias("party"), (F.col("d") * 100.0 / F.col("n")).alias("support")),
        F.struct(F.lit(REPUBLICAN).alias("party"), (F.col("r") * 100.0 / F.col("n")).alias("support")),
    )
    rows = counts.select("year", F.explode(sides).alias("s")).select("year", "s.*")
    return rows.groupBy("year", "party").agg(F.avg("support").alias("avg_support"))


def _national_sides(national: DataFrame) -> DataFrame:
    sides = F.array(
        F.struct(F.lit(DEMOCRAT).alias("party"), F.col("d_pv2p").alias("pv2p")),
        F.struct(F.lit(REPUBLICAN).alias("party"), F.col("r_pv2p").alias("pv2p")),
    )
    return national.select("year", F.explode(sides).alias("s")).select("year", "s.*")


def _national_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Shares, late polls, second-quarter growth and office per period and side."""
    monthly = cut_lineage(domain.monthly_panel(spark, folder))
    national = domain.national_shares(monthly)
    growth = (
        domain.quarterly_growth(monthly)
        .filter(F.col("quarter") == 2)
        .select("year", F.col("growth").alias("growth_q2"))
    )
    complete = (
        _national_sides(national)
        .join(_national_polls(monthly), ["year", "party"], "full")
        .join(growth, "year", "left")
        .distinct()
        .filter(F.col("growth_q2").isNotNull())
    )
    return complete.join(domain.incumbents(monthly), "year", "left").withColumn(
        "is_incumbent", F.col("in_office") == F.col("party")
    )


def polls_full_economy(spark: SparkSession, folder: str) -> DataFrame:
    """Means on the incumbent's and the challenger's side, after a full and a left join."""
    panel = _national_panel(spark, folder).filter(F.col("is_incumbent").isNotNull())
    side = F.when(F.col("is_incumbent"), "incumbent").otherwise("challenger").alias("side")
    return round_columns(
        panel.groupBy(side).agg(
            F.avg("pv2p").alias("mean_pv2p"),
            F.avg("avg_support").alias("mean_support"),
            strict_avg("avg_support").alias("strict_support"),
            F.avg("growth_q2").alias("mean_growth"),
            F.count(F.lit(1)).alias("periods"),
        )
    )


GROWTH = Formula("growth", "pv2p", ("growth_q2",))


def poll_growth_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """0.7 x grade-weighted polls + 0.3 x growth regression, for the side in office and the other."""
    panel = _national_panel(spark, folder).filter(F.col("is_incumbent").isNotNull())
    panel = cut_lineage(panel)
    train, now = domain.train_and_score(panel)
    fits = ols_by_key(train, ["is_incumbent"], [GROWTH])
    economy = predict(
        now.select("party", "is_incumbent", "growth_q2").join(fits, "is_incumbent"), [GROWTH]
    )
    polls = tier_blend(_tiered(spark, folder), ["party"], TIER_WEIGHTS, "weighted_pct")
    out = economy.join(polls, "party").withColumn(
        "blended", blend((POLL_WEIGHT, "weighted_pct"), (GROWTH_WEIGHT, "growth_fit"))
    )
    return round_columns(
        out.select(
            "party",
            F.when(F.col("is_incumbent"), "incumbent").otherwise("challenger").alias("side"),
            "weighted_pct",
            F.col("growth_fit").alias("economy_pct"),
            "growth_r2",
            "blended",
        )
    )


def party_in_office_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the side in office, picked by name from the two share columns."""
    returns = cut_lineage(domain.unit_returns(spark, folder))
    national = domain.national_shares(returns)
    out = national.join(domain.incumbents(returns), "year").withColumn(
        "incumbent_pv2p", side_value("in_office", "d_pv2p", "r_pv2p")
    )
    return round_columns(out.select("year", "in_office", "incumbent_pv2p"))


QUERIES = {
    f.__name__: f
    for f in (
        recent_poll_average,
        grade_weighted_polls,
        tier_averages,
        grade_counts,
        polls_full_economy,
        poll_growth_ensemble,
        party_in_office_share,
    )
}
