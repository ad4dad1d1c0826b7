"""The operators bound to the election CSV inputs (see ``sources.schemas``).

Every function takes and returns DataFrames; nothing here depends on the number of
units, so a county table runs through the same steps as a state table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.cleaning import (
    clean_names,
    drop_subheader,
    numeric_columns,
    override_values,
    parse_short_date,
    to_number,
)
from panelcast.functions.shares import DEMOCRAT, REPUBLICAN, lean, share_of, two_party_margin
from panelcast.operators.ensemble import POLLS
from panelcast.operators.moments import Formula
from panelcast.operators.panel import (
    assemble_features,
    change_columns,
    lag_columns,
    period_columns,
    wide_to_long,
)
from panelcast.operators.polls import label_values, recent_polls

PARTIES = {"democrat": DEMOCRAT, "republican": REPUBLICAN}
CANDIDATE_SHARE = Formula(
    "plus", "pv", ("lag_pv2p", "white_chng", "incumbent_party")
)
FORMULAS = (CANDIDATE_SHARE, POLLS)


def side_rows(returns: DataFrame) -> DataFrame:
    """Statewide returns to one row per state, year and side, with the share of the time before."""
    shares = returns.withColumnsRenamed({"state": "unit"}).withColumns(
        {"d_pv": share_of("D", "total"), "r_pv": share_of("R", "total")}
    )
    lagged = lag_columns(
        shares, ["unit"], "year", {"lag_d": ("D_pv2p", 1), "lag_r": ("R_pv2p", 1)}
    )
    sides = (
        f"'{DEMOCRAT}', d_pv, D_pv2p, lag_d, D, '{REPUBLICAN}', r_pv, R_pv2p, lag_r, R"
    )
    return lagged.selectExpr(
        "unit",
        "year",
        "D_pv2p AS d_pv2p",
        "R_pv2p AS r_pv2p",
        f"stack(2, {sides}) AS (party, pv, pv2p, lag_pv2p, votes)",
    )


def poll_means(polls: DataFrame, within_weeks: int = 5) -> DataFrame:
    """Mean of the late poll averages per state, year and side."""
    return (
        polls.filter(F.col("weeks_left") <= within_weeks)
        .withColumn("party", label_values("party", PARTIES))
        .groupBy(F.col("state").alias("unit"), "year", "party")
        .agg(F.avg("avg_poll").alias("avg_poll"))
    )


def demographic_changes(demographics: DataFrame, states: DataFrame) -> DataFrame:
    """Change of every demographic share since the previous row of the state, by state name."""
    tidy = clean_names(demographics).withColumnRenamed("state", "code")
    series = [c for c in tidy.columns if c not in ("code", "year")]
    changes = change_columns(tidy, ["code"], "year", {f"{c}_chng": (c, 1) for c in series})
    named = changes.join(states.select("code", "unit"), "code", "left")
    return named.select("unit", "year", *[f"{c}_chng" for c in series])


def income_rows(
    wide: DataFrame, quarters: Mapping[str, int], names: DataFrame | None = None
) -> DataFrame:
    """Income columns of the chosen quarters as rows; ``names(unit_id, unit)`` overrides labels."""
    numbers = numeric_columns(wide.select("unit_id", "unit", *quarters), list(quarters))
    if names is not None:
        numbers = override_values(numbers, names, "unit_id", "unit")
    return wide_to_long(numbers, ["unit"], quarters, "year", "rdi_q2")


def quarter_growth(economy: DataFrame, quarter: int = 2) -> DataFrame:
    return economy.filter(F.col("quarter") == quarter).select(
        "year", F.col("GDP_growth_qt").alias("gdp_q2")
    )


def office(national: DataFrame) -> DataFrame:
    """Side in office per election, from the national returns."""
    return national.filter("incumbent_party").select(
        "year", label_values("party", PARTIES).alias("in_office")
    )


def state_features(
    returns: DataFrame,
    polls: DataFrame,
    national: DataFrame,
    demographics: DataFrame,
    income: DataFrame,
    states: DataFrame,
) -> DataFrame:
    """The model input from the separate files."""
    features = assemble_features(
        poll_means(polls), income, side_rows(returns), office(national), demographic_changes(demographics, states)
    )
    return features.withColumnRenamed("is_incumbent", "incumbent_party")


def live_averages(
    feed: DataFrame, event_date: str, candidates: Mapping[str, str], within_weeks: int = 2
) -> DataFrame:
    """Mean of the feed's late polls per state and side."""
    recent = recent_polls(
        feed,
        F.lit(event_date).cast("date"),
        parse_short_date("end_date"),
        "state",
        "candidate_name",
        candidates,
        within_weeks,
    )
    return recent.groupBy(F.col("state").alias("unit"), "party").agg(F.avg("pct").alias("avg_poll"))


def scoring_rows(
    features: DataFrame,
    live: DataFrame,
    demographics: DataFrame,
    last_election: int,
    demographic_year: int,
    in_office: str,
) -> DataFrame:
    """Inputs of the next election per state and side, looked up by key.

    Last share, latest demographic change and live poll average; a state without a
    poll keeps a NULL and gets no poll forecast.
    """
    last = features.filter(F.col("year") == last_election).select(
        "unit", "party", F.col("pv2p").alias("lag_pv2p")
    )
    latest = demographics.filter(F.col("year") == demographic_year).drop("year")
    return (
        last.filter(F.col("lag_pv2p").isNotNull())
        .join(latest, "unit", "left")
        .join(live, ["unit", "party"], "left")
        .withColumn("incumbent_party", F.col("party") == in_office)
    )


def county_margins(history: DataFrame, latest: DataFrame, year: int, columns: Sequence[str]) -> DataFrame:
    """County margins of all elections, the latest from raw counts under a sub-header.

    ``columns`` names county key, county name, side D and side R of the latest file.
    """
    fips, county, d, r = columns
    counts = drop_subheader(latest, [d, r]).select(
        F.lit(year).alias("year"),
        F.col(f"`{county}`").alias("county"),
        F.col(f"`{fips}`").alias("fips"),
        two_party_margin(to_number(F.col(f"`{d}`")), to_number(F.col(f"`{r}`"))).alias("margin"),
    )
    earlier = history.select("year", "county", "fips", F.col("D_win_margin").alias("margin"))
    return earlier.unionByName(counts).withColumn("lean", lean("margin"))


def loyal_county_shift(margins: DataFrame, first: int, last: int) -> DataFrame:
    """Mean change of margin in counties with the same lean in both elections."""
    ends = period_columns(
        margins, ["county", "fips"], "year", "margin", {first: "first_margin", last: "last_margin"}
    )
    loyal = ends.withColumn("lean", lean("first_margin")).filter(F.col("lean") == lean("last_margin"))
    return loyal.groupBy("lean").agg(
        F.avg(F.col("last_margin") - F.col("first_margin")).alias("mean_shift"),
        F.count(F.lit(1)).alias("counties"),
    )


def binomial_input(
    returns: DataFrame, polls: DataFrame, eligible: DataFrame, weeks_left: int = 5
) -> DataFrame:
    """Votes, eligible population and poll average per state, year and side."""
    late = polls.filter(F.col("weeks_left") == weeks_left).select(
        F.col("state").alias("unit"), "year", label_values("party", PARTIES).alias("party"), "avg_poll"
    )
    population = eligible.select(
        F.col("state").alias("unit"), "year", to_number("VEP").alias("trials")
    ).filter(~F.col("unit").isin("United States", "District of Columbia"))
    votes = side_rows(returns).select("unit", "year", "party", F.col("votes").alias("successes"))
    return votes.join(late, ["unit", "year", "party"]).join(population, ["unit", "year"])
