"""First, last and scored periods come from the data."""

import os

import pyarrow.parquet as pq
import pytest
from oracle_compare import connect, differences
from panelcast.plans import domain, models, oracle, polls, returns
from pyspark.sql import functions as F

QUERIES = {**returns.QUERIES, **polls.QUERIES, **models.QUERIES}


@pytest.fixture(scope="module")
def later(spark, medium, tmp_path_factory):
    """The tables with orders of 1995 gone and a sixth of all moved on by three years."""
    folder = str(tmp_path_factory.mktemp("later"))
    for name in ("region", "nation", "customer", "events"):
        os.symlink(f"{medium}/{name}.parquet", f"{folder}/{name}.parquet")
    orders = spark.read.parquet(f"{medium}/orders.parquet").where(F.year("o_orderdate") > 1995)
    moved = F.when(F.col("o_orderkey") % 6 == 0, F.add_months("o_orderdate", 36)).otherwise(F.col("o_orderdate"))
    changed = orders.withColumn("o_orderdate", moved.cast(orders.schema["o_orderdate"].dataType))
    schema = pq.read_schema(f"{medium}/orders.parquet")
    pq.write_table(changed.toArrow().select(schema.names).cast(schema), f"{folder}/orders.parquet")
    return folder


def test_periods(spark, later):
    assert domain.periods(spark, later) == (1996, 2004)


NAMES = ["two_period_swing", "panel_lags", "loyal_units_shift", "wide_to_long_series", "ols_per_unit", "unpooled_forecast", "model_summaries", "poll_growth_ensemble"]


@pytest.mark.parametrize("name", NAMES)
def test_later_years_are_scored(spark, later, name):
    df = QUERIES[name](spark, later)
    assert differences(df, connect(later), oracle.statements()[name]) == []


def test_a_named_period_is_scored(spark, later):
    features = domain.feature_rows(spark, later)
    train, score = domain.train_and_score(features, 2000)
    assert {r[0] for r in score.select("year").distinct().collect()} == {2000}
    assert train.agg(F.max("year")).first()[0] == 1999
