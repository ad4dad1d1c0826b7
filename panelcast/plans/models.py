"""Regressions, forecasts, intervals, hold-outs and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.cleaning import round_columns
from panelcast.functions.shares import lean, share_of, two_party_margin
from panelcast.operators.draws import binomial_draws, margin_summary, turnout_draws
from panelcast.operators.ensemble import (
    FORMULAS,
    PLUS,
    POLLS,
    combine_sides,
    interval_columns,
    interval_rows,
    pooled_rows,
    unpooled_rows,
)
from panelcast.operators.histogram import histogram
from panelcast.operators.holdout import holdout_fits, holdout_pooled_rows, holdout_unpooled_rows
from panelcast.operators.logit import logit_by_key, response
from panelcast.operators.moments import Formula
from panelcast.operators.ols import (
    correlation,
    ols_by_key,
    pooled_ols,
    predict,
    residuals,
    slope_tests,
)
from panelcast.operators.outcomes import (
    compare_to_actual,
    confusion,
    error_rollup,
    model_metrics,
    weighted_totals,
)
from panelcast.operators.ordered import order_indexes
from panelcast.operators.qr import qr_fits
from panelcast.plans import domain
from panelcast.plans.returns import unit_classes
from panelcast.session import cut_lineage, small_side
from panelcast.sources.inline import TURNOUT_SCENARIOS, broadcast_inline, inline_table
from panelcast.sources.readers import table

LEVEL = 0.95
SIMPLE = Formula("simple", "pv", ("avg_poll",))
PRICE = Formula("price", "l_extendedprice", ("l_quantity", "l_discount", "returned"))
SUPPLIER = Formula("price", "l_extendedprice", ("l_quantity", "l_discount", "l_tax"))
CONDITION_MODELS = (
    Formula("growth", "pv2p", ("growth_q2",)),
    Formula("growth_terms", "pv2p", ("growth_q2", "net_approve", "two_terms")),
    Formula("income_terms", "pv2p", ("income_growth", "net_approve", "two_terms")),
    Formula("terms", "pv2p", ("net_approve", "two_terms")),
)
QUANTILES = (0.05, 0.5, 0.95)


def _renamed(f: Formula, *stats: str) -> list[Column]:
    """Coefficients by predictor name and the chosen statistics of one formula."""
    columns = [F.col(f"{f.name}_b0").alias(f"{f.name}_intercept")]
    columns += [F.col(f"{f.name}_b_{i}").alias(f"{f.name}_{x}") for i, x in enumerate(f.xs)]
    return columns + [F.col(f"{f.name}_{s}") for s in stats]


def ols_simple(spark: SparkSession, folder: str) -> DataFrame:
    """Share on poll average over all units and periods, per side."""
    fits = ols_by_key(domain.feature_rows(spark, folder), ["party"], [SIMPLE])
    return round_columns(
        fits.select(
            "party",
            correlation(SIMPLE).alias("correlation"),
            F.col("simple_b_0").alias("slope"),
            F.col("simple_b0").alias("intercept"),
            F.col("simple_r2").alias("r2"),
            F.col("simple_adj_r2").alias("adj_r2"),
            F.col("simple_n").alias("n"),
        )
    )


def ols_slope_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Standard error, t and p-value of the same slopes."""
    fits = ols_by_key(domain.feature_rows(spark, folder), ["party"], [SIMPLE])
    tested = slope_tests(fits, SIMPLE)
    return round_columns(
        tested.select(
            "party",
            F.col("simple_se_0").alias("se"),
            F.col("simple_t_0").alias("t"),
            F.col("simple_p_0").alias("p"),
        )
    )


def _line_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")


def ols_multi_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Three-term fit over every line item, one term boolean, and the fit at a literal row."""
    fits = ols_by_key(_line_items(spark, folder).withColumn("model", F.lit("price")), ["model"], [PRICE])
    scoring = inline_table(
        spark,
        [("price", 25.0, 0.05, True)],
        "model STRING, l_quantity DOUBLE, l_discount DOUBLE, returned BOOLEAN",
    )
    out = predict(fits.join(F.broadcast(scoring), "model"), [PRICE])
    return round_columns(
        out.select(*_renamed(PRICE, "r2", "fit"), F.col("price_n").alias("n")), 4
    )


def ols_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """Three-term fit for every supplier."""
    fits = ols_by_key(table(spark, folder, "lineitem"), ["l_suppkey"], [SUPPLIER])
    return round_columns(
        fits.select("l_suppkey", *_renamed(SUPPLIER, "r2", "df"), F.sqrt("price_mse").alias("rmse")), 4
    )


def holdout_by_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """The same fits with every ship year held out in turn."""
    items = table(spark, folder, "lineitem").withColumn("year", F.year("l_shipdate"))
    fits = holdout_fits(items, ["l_suppkey"], "year", [SUPPLIER])
    return round_columns(
        fits.select(
            "l_suppkey", "year", *_renamed(SUPPLIER, "r2"), F.col("price_n").alias("n")
        ),
        4,
    )


def _train(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return domain.train_and_score(domain.feature_rows(spark, folder))


def ols_ten_predictors(spark: SparkSession, folder: str) -> DataFrame:
    """Line value on ten predictors per return flag, by merged triangular factors; the last coefficient shown."""
    ship = {"ship_year": F.year, "ship_month": F.month, "ship_day": F.dayofmonth}
    lines = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice",
        (F.col("l_quantity") * F.col("l_discount")).alias("quantity_discount"),
        (F.col("l_quantity") * F.col("l_tax")).alias("quantity_tax"),
        (F.col("l_discount") * F.col("l_tax")).alias("discount_tax"),
        *[part("l_shipdate").alias(name) for name, part in ship.items()],
    )
    xs = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "quantity_discount", "quantity_tax", "discount_tax", *ship]
    fits = qr_fits(lines, ["flag"], "l_extendedprice", xs)
    last = F.element_at("coefficients", -1).alias("ship_day")
    return round_columns(fits.select("flag", "n", "terms", "r2", "adj_r2", F.sqrt("mse").alias("spread"), last), 4)


def ols_far_from_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Order value on a number whose spread is tiny beside its size, per status."""
    far = (F.col("o_orderkey") + F.lit(1e9)).alias("x")
    orders = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"), far, "o_totalprice")
    fits = qr_fits(orders, ["status"], "o_totalprice", ["x"])
    return round_columns(fits.select("status", "n", F.element_at("coefficients", 1).alias("slope"), "r2"))


def ols_per_unit(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _train(spark, folder)
    fits = ols_by_key(train, ["unit", "party"], FORMULAS)
    return round_columns(
        fits.select(
            "unit",
            "party",
            *_renamed(PLUS, "r2", "mse", "df"),
            *_renamed(POLLS, "r2", "mse", "df"),
        )
    )


def ols_by_class(spark: SparkSession, folder: str) -> DataFrame:
    """The per-unit fits pooled within each class of units, per side."""
    train, _ = _train(spark, folder)
    classes = small_side(unit_classes(spark, folder).select("unit", "class"))
    fits = ols_by_key(train.join(classes, "unit"), ["class", "party"], FORMULAS)
    return round_columns(
        fits.select(
            "class",
            "party",
            *_renamed(PLUS, "r2", "mse", "df"),
            *_renamed(POLLS, "r2", "mse", "df"),
        )
    )


def ols_fixed_effects(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _train(spark, folder)
    fits = pooled_ols(train, ["unit", "party"], ["party"], FORMULAS)
    return round_columns(
        fits.select(
            "unit",
            "party",
            *_renamed(PLUS, "r2", "mse", "df"),
            *_renamed(POLLS, "r2", "mse", "df"),
        )
    )


def fit_residuals(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _train(spark, folder)
    fits = ols_by_key(train, ["unit", "party"], FORMULAS)
    out = residuals(train, fits, ["unit", "party"], FORMULAS)
    return round_columns(out.select("unit", "year", "party", "plus_residual", "polls_residual"))


def unpooled_forecast(spark: SparkSession, folder: str) -> DataFrame:
    train, score = _train(spark, folder)
    return round_columns(combine_sides(unpooled_rows(train, score), ["unit"]))


def unpooled_intervals(spark: SparkSession, folder: str) -> DataFrame:
    train, score = _train(spark, folder)
    return round_columns(interval_columns(unpooled_rows(train, score, level=LEVEL), ["unit"]))


def pooled_forecast(spark: SparkSession, folder: str) -> DataFrame:
    train, score = _train(spark, folder)
    return round_columns(combine_sides(pooled_rows(train, score), ["unit"]))


def pooled_intervals(spark: SparkSession, folder: str) -> DataFrame:
    train, score = _train(spark, folder)
    return round_columns(interval_columns(pooled_rows(train, score, level=LEVEL), ["unit"]))


def interval_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Point, low and high per unit, side and model, with the unit's place in four orders.

    ``order_index`` goes by the first side's polls; the others name their side and model.
    """
    train, score = _train(spark, folder)
    wide = interval_columns(unpooled_rows(train, score, level=LEVEL), ["unit"])
    orders = {"order_index": "d_polls", **{f"order_{c}": c for c in ("d_plus", "r_polls", "r_plus")}}
    wide = order_indexes(wide, {name: [c, "unit"] for name, c in orders.items()})
    return round_columns(interval_rows(wide, ["unit", *orders]))


def _holdout(features: DataFrame, pooled: bool) -> DataFrame:
    rows = holdout_pooled_rows(features) if pooled else holdout_unpooled_rows(features)
    keys = ["unit", "year"]
    forecast = combine_sides(rows, keys, quality=False)
    return compare_to_actual(
        forecast.select(*keys, "dem_p", "rep_p"), domain.actual_shares(features), keys
    )


def _error_columns(compared: DataFrame) -> DataFrame:
    return compared.select(
        "unit",
        "year",
        "dem_p",
        "rep_p",
        "predicted_margin",
        "actual_margin",
        "margin_error",
        "predicted_winner",
        "actual_winner",
    )


def holdout_unpooled(spark: SparkSession, folder: str) -> DataFrame:
    features = domain.feature_rows(spark, folder)
    return round_columns(_error_columns(_holdout(features, pooled=False)))


def holdout_pooled(spark: SparkSession, folder: str) -> DataFrame:
    features = domain.feature_rows(spark, folder)
    return round_columns(_error_columns(_holdout(features, pooled=True)))


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Fit and hold-out quality of the pooled and the unpooled forecast side by side."""
    features = domain.feature_rows(spark, folder)
    train, score = domain.train_and_score(features)
    pooled = model_metrics(
        combine_sides(pooled_rows(train, score), ["unit"]), _holdout(features, pooled=True), "pooled"
    )
    unpooled = model_metrics(
        combine_sides(unpooled_rows(train, score), ["unit"]), _holdout(features, pooled=False), "unpooled"
    )
    return round_columns(pooled.unionByName(unpooled))


def model_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Four fits of the share on national conditions, for the side in office and the other.

    R-squared and MSE of each, and its prediction for the last period.
    """
    monthly = cut_lineage(domain.monthly_panel(spark, folder))
    yearly = domain.yearly_panel(monthly)
    conditions = cut_lineage(domain.national_conditions(monthly))
    features = domain.features_from(yearly, conditions.select("year", "in_office"))
    rows = features.join(conditions, "year").withColumn("held", F.col("party") == F.col("in_office"))
    last = domain.last_period(monthly)
    fits = ols_by_key(rows.filter(F.col("year") < last), ["held"], CONDITION_MODELS)
    now = conditions.filter(F.col("year") == last).withColumn(
        "held", F.explode(F.array(F.lit(True), F.lit(False)))
    )
    scored = predict(now.join(fits, "held"), CONDITION_MODELS)
    entries = ", ".join(
        f"'{f.name}', {f.name}_n, {f.name}_r2, {f.name}_mse, {f.name}_fit" for f in CONDITION_MODELS
    )
    return round_columns(
        scored.selectExpr(
            "CASE WHEN held THEN 'incumbent' ELSE 'challenger' END AS side",
            f"stack({len(CONDITION_MODELS)}, {entries}) AS (model, n, r2, mse, prediction)",
        )
    )


def _compared_now(spark: SparkSession, folder: str) -> DataFrame:
    """The forecast of the last period next to its outcome."""
    features = domain.feature_rows(spark, folder)
    train, score = domain.train_and_score(features)
    forecast = combine_sides(unpooled_rows(train, score), ["unit"])
    actual = domain.actual_shares(score).drop("year")
    return compare_to_actual(forecast.select("unit", "dem_p", "rep_p"), actual, ["unit"])


def weighted_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted and actual winner-take-all totals, with one unit outside the table."""
    compared = cut_lineage(_compared_now(spark, folder))
    weights = domain.unit_weights(spark, folder)
    parts = []
    for kind in ("predicted", "actual"):
        label = f"{kind}_winner"
        external = broadcast_inline(spark, [("D", 3)], f"{label} STRING, ev BIGINT")
        totals = weighted_totals(compared, label, weights, "unit", "ev", external)
        parts.append(
            totals.withColumnRenamed(label, "winner").withColumn("outcome", F.lit(kind))
        )
    return parts[0].unionByName(parts[1])


def error_summary(spark: SparkSession, folder: str) -> DataFrame:
    compared = _compared_now(spark, folder).join(domain.battlegrounds(spark), "unit", "left")
    flagged = compared.withColumn("is_battleground", F.coalesce("is_battleground", F.lit(False)))
    labels = ("All Units", "Battleground Units", "Non-Battleground Units")
    out = round_columns(error_rollup(flagged, "is_battleground", labels), 2)
    return out.withColumnsRenamed(
        {
            "category": "Category",
            "avg_d": "Democratic Error",
            "avg_r": "Republican Error",
            "avg_margin": "Margin Error",
            "hit_rate": "Hit Rate",
            "units": "Units",
        }
    ).orderBy("Category")


def winner_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return confusion(_compared_now(spark, folder))


def battleground_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Margins and their error in the battleground units, smallest error first."""
    compared = _compared_now(spark, folder).join(domain.battlegrounds(spark), "unit", "left_semi")
    return round_columns(
        compared.select("unit", "actual_margin", "predicted_margin", "margin_error"), 2
    ).orderBy("margin_error", "unit")


def fit_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of R-squared and MSE over units, per side, model and statistic."""
    train, _ = _train(spark, folder)
    fits = ols_by_key(train, ["unit", "party"], FORMULAS)
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("model"),
                F.lit(s).alias("statistic"),
                F.col(f"{f.name}_{s}").alias("value"),
            )
            for f in FORMULAS
            for s in ("r2", "mse")
        ]
    )
    long = cut_lineage(fits.select("unit", "party", F.explode(entries).alias("e")).select("party", "e.*"))
    return round_columns(histogram(long, ["party", "model", "statistic"], "value", 10))


def margin_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of sub-unit margins per period and lean, 100 bins."""
    margins = domain.subunit_returns(spark, folder).select(
        "year", share_of(F.col("d") - F.col("r"), F.col("d") + F.col("r")).alias("margin")
    )
    leaning = margins.withColumn("lean", lean("margin")).filter(F.col("lean").isNotNull())
    return round_columns(histogram(cut_lineage(leaning), ["year", "lean"], "margin", 100))


def _logit(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Fits on earlier periods, and the period they predict."""
    train, score = domain.train_and_score(domain.feature_rows(spark, folder))
    return logit_by_key(train, ["unit", "party"], "successes", "trials", ["avg_poll"]), score


def _responses(fits: DataFrame, score: DataFrame) -> DataFrame:
    """Every scored key; one without a fit has NULLs and has not converged."""
    scored = score.select("unit", "party", "avg_poll", "trials").join(fits, ["unit", "party"], "left")
    return scored.withColumn("converged", F.coalesce("converged", F.lit(False))).selectExpr(
        "*", f"{response(['avg_poll'])} AS probability"
    )


def binomial_per_unit(spark: SparkSession, folder: str) -> DataFrame:
    fits, score = _logit(spark, folder)
    return round_columns(
        _responses(fits, score).select("unit", "party", "b0", "b_0", "probability", "converged")
    )


def binomial_with_demographics(spark: SparkSession, folder: str) -> DataFrame:
    """The same per-unit fit with the demographic change as a second predictor."""
    features = domain.feature_rows(spark, folder)
    fits = logit_by_key(
        features, ["unit", "party"], "successes", "trials", ["avg_poll", "segment_chng"]
    )
    return round_columns(fits.select("unit", "party", "b0", "b_0", "b_1", "deviance", "converged"))


def _side_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    fits, score = _logit(spark, folder)
    rows = _responses(fits, score)
    return rows.groupBy("unit").agg(
        F.max("trials").alias("trials"),
        F.bool_and("converged").alias("converged"),
        F.max(F.when(F.col("party") == "D", F.col("probability"))).alias("p_d"),
        F.max(F.when(F.col("party") == "R", F.col("probability"))).alias("p_r"),
    )


def _binomial(sides: DataFrame) -> DataFrame:
    return binomial_draws(sides, ["unit"], "trials", {"d": "p_d", "r": "p_r"}, 10_000, seed=42)


def draw_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """10,000 outcome draws per unit: win rate, mean, median and tails of the margin."""
    sides = cut_lineage(_side_probabilities(spark, folder))
    draws = _binomial(sides)
    summary = margin_summary(draws, ["unit"], "d", "r", QUANTILES)
    return round_columns(summary.join(sides.select("unit", "converged"), "unit"))


def _turnout(sides: DataFrame) -> DataFrame:
    return turnout_draws(sides, ["unit"], "trials", "p_d", "p_r", TURNOUT_SCENARIOS, 1_000, seed=42)


def draw_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of the drawn margins per unit and scenario, 100 bins, edges to three digits.

    The margins rest on an iterated fit, whose last digits depend on the order of its sums.
    """
    votes = _turnout(cut_lineage(_side_probabilities(spark, folder)))
    margins = votes.select("unit", "scenario", two_party_margin("d_votes", "r_votes").alias("margin"))
    return round_columns(histogram(cut_lineage(margins), ["unit", "scenario"], "margin", 100), 3)


def binomial_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of the margins of 10,000 binomial draws per unit, 100 bins, edges to three digits."""
    draws = _binomial(cut_lineage(_side_probabilities(spark, folder)))
    margins = cut_lineage(draws.select("unit", two_party_margin("d", "r").alias("margin")))
    return round_columns(histogram(margins, ["unit"], "margin", 100), 3)


def turnout_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """1,000 turnout draws per unit and scenario."""
    sides = cut_lineage(_side_probabilities(spark, folder))
    votes = _turnout(sides)
    summary = margin_summary(votes, ["unit", "scenario"], "d_votes", "r_votes", QUANTILES)
    return round_columns(summary.join(sides.select("unit", "converged"), "unit"))


QUERIES = {
    f.__name__: f
    for f in (
        ols_simple,
        ols_slope_tests,
        ols_multi_predict,
        ols_ten_predictors,
        ols_far_from_zero,
        ols_by_supplier,
        holdout_by_supplier,
        ols_per_unit,
        ols_by_class,
        ols_fixed_effects,
        fit_residuals,
        unpooled_forecast,
        unpooled_intervals,
        pooled_forecast,
        pooled_intervals,
        interval_feed,
        holdout_unpooled,
        holdout_pooled,
        model_comparison,
        model_summaries,
        weighted_outcome,
        error_summary,
        winner_confusion,
        battleground_errors,
        fit_histograms,
        margin_histogram,
        binomial_per_unit,
        binomial_with_demographics,
        draw_distribution,
        draw_histogram,
        binomial_histogram,
        turnout_scenarios,
    )
}
