"""Per-key binomial fits against NumPy and Spark's whole-table solver."""

import math

import numpy as np
import pytest
from panelcast.operators import logit
from panelcast.operators.logit import logit_by_key
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

SCHEMA = "key STRING, s BIGINT, n BIGINT, x DOUBLE, z DOUBLE"


def data(keys=3, rows=8, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(keys):
        for _ in range(rows):
            x, z = float(rng.normal(45, 4)), float(rng.normal())
            n = int(rng.integers(50, 400))
            p = 1 / (1 + math.exp(-(-3 + 0.06 * x + 0.2 * k + 0.3 * z)))
            out.append((f"k{k}", int(rng.binomial(n, p)), n, x, z))
    return out


def newton(rows, columns):
    x = np.array([[1.0, *[r[c] for c in columns]] for r in rows])
    s = np.array([r[1] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (n * mu * (1 - mu))[:, None]), x.T @ (s - n * mu))
    return beta


@pytest.mark.parametrize("broadcast_keys", [100, 0])
def test_every_key_equals_numpy(spark, broadcast_keys):
    """Also when the keys are too many for a broadcast."""
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    for xs, columns in ((["x"], [3]), (["x", "z"], [3, 4])):
        fits = logit_by_key(df, ["key"], "s", "n", xs, broadcast_keys=broadcast_keys).collect()
        assert len(fits) == 3
        for fit in fits:
            beta = newton([r for r in rows if r[0] == fit["key"]], columns)
            got = [fit["b0"], *[fit[f"b_{i}"] for i in range(len(xs))]]
            assert np.allclose(got, beta, rtol=1e-7)
            assert fit["converged"] and 1 <= fit["steps"] <= 8


def test_equals_the_whole_table_solver(spark):
    df = spark.createDataFrame(data(keys=1), SCHEMA)
    fit = logit_by_key(df, ["key"], "s", "n", ["x"]).first()
    expanded = df.select("x", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("s").cast("double").alias("w")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") - F.col("s")).cast("double").alias("w")),
    )).alias("e")).select("x", "e.*")
    model = GeneralizedLinearRegression(family="binomial", weightCol="w", tol=1e-10).fit(
        VectorAssembler(inputCols=["x"], outputCol="features").transform(expanded)
    )
    assert math.isclose(fit["b0"], model.intercept, rel_tol=1e-6)
    assert math.isclose(fit["b_0"], model.coefficients[0], rel_tol=1e-6)


def test_rows_with_equal_predictors_are_merged(spark):
    """The fit is that of the merged rows, the deviance that of the rows as they came."""
    rows = data(keys=1)
    split = [(k, s // 3, n // 2, x, z) for k, s, n, x, z in rows]
    split += [(k, s - s // 3, n - n // 2, x, z) for k, s, n, x, z in rows]
    whole = logit_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], "s", "n", ["x"]).first()
    parts = logit_by_key(spark.createDataFrame(split, SCHEMA), ["key"], "s", "n", ["x"]).first()
    assert math.isclose(whole["b_0"], parts["b_0"], rel_tol=1e-9)
    for fit, table in ((whole, rows), (parts, split)):
        deviance = 0.0
        for _, s, n, x, _ in table:
            mu = 1 / (1 + math.exp(-(fit["b0"] + fit["b_0"] * x)))
            deviance += 2 * (s * math.log(s / (n * mu)) + (n - s) * math.log((n - s) / (n * (1 - mu))))
        assert math.isclose(fit["deviance"], deviance, rel_tol=1e-7)


def test_edge_keys(spark):
    rows = [
        *[("none", 0, 20, float(x), 0.0) for x in range(5)],
        *[("all", 20, 20, float(x), 0.0) for x in range(5)],
        *[("split", 20 * (x > 2), 20, float(x), 0.0) for x in range(6)],
        *[("flat", 5 + x, 20, 3.0, 0.0) for x in range(4)],
        ("gap", 5, 20, None, 0.0),
        ("gap", 5, 20, 1.0, 0.0),
        ("gap", 9, 20, 2.0, 0.0),
        ("gap", 0, 0, 9.0, 0.0),
    ]
    got = {
        r["key"]: r
        for r in logit_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], "s", "n", ["x"]).collect()
    }
    assert len(got) == 5
    assert got["none"]["b0"] < -8 and got["all"]["b0"] > 8
    assert got["split"]["b_0"] > 5 and abs(got["split"]["deviance"]) < 1e-3
    # a constant predictor is not identified: the intercept carries the pooled rate
    assert got["flat"]["b_0"] is None
    assert math.isclose(1 / (1 + math.exp(-got["flat"]["b0"])), 26 / 80, rel_tol=1e-8)
    rate = [1 / (1 + math.exp(-(got["gap"]["b0"] + got["gap"]["b_0"] * x))) for x in (1.0, 2.0)]
    assert np.allclose(rate, [5 / 20, 9 / 20], rtol=1e-7)


def test_binomial_forecast_does_not_see_the_scored_period(spark, small, monkeypatch):
    """Other outcomes of the scored period leave the coefficients as they are."""
    from panelcast.plans import domain, models

    before = {(r["unit"], r["party"]): (r["b0"], r["b_0"]) for r in models.binomial_per_unit(spark, small).collect()}
    features = domain.feature_rows

    def changed(spark, folder):
        last = F.col("year") == F.lit(domain.periods(spark, small)[1])
        return features(spark, folder).withColumn("successes", F.when(last, F.lit(0)).otherwise(F.col("successes")))

    monkeypatch.setattr(domain, "feature_rows", changed)
    after = models.binomial_per_unit(spark, small).collect()
    assert {(r["unit"], r["party"]): (r["b0"], r["b_0"]) for r in after} == before
    assert all(r["converged"] is not None for r in after)


def many_keys(spark, keys=300, rows=9000):
    """A third of the rows belongs to one key."""
    df = spark.range(rows).withColumn("key", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % keys).cast("string"))
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 100
    return df.select("key", F.pmod(F.col("id"), F.lit(37)).alias("s"), F.lit(40).alias("n"), x.alias("x"))


def test_no_step_moves_the_design(spark):
    """Beyond the broadcast limit the written design is read in place; only the state is shuffled."""
    keys = ["key"]
    design = logit.cut_lineage(logit.binomial_design(many_keys(spark), keys, "s", "n", ["x"]))
    heavy = logit.heavy_keys(design, keys, 8)
    assert [r["key"] for r in heavy.collect()] == ["0"]
    spread = logit.spread_design(design, heavy, keys, 1, 8)
    state = logit.cut_lineage(logit._start(design, keys, 1))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = logit._step(spread, state, keys, 1, 1e-8, heavy)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Scan ExistingRDD" in line and "x_0" in line)
    depth = lines[at].index("Scan")
    above, edge = [], depth
    for line in reversed(lines[:at]):
        start = len(line) - len(line.lstrip(" :+-"))
        if start < edge:
            above.append(line)
            edge = start
    join = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not any("Exchange" in line or "Sort " in line for line in above[:join]), plan
    sizes = [len(p) for p in spread.rdd.glom().collect()]
    assert max(sizes) <= 2.5 * sum(sizes) / len(sizes)


def test_split_keys_fit_like_broadcast_ones(spark):
    df = many_keys(spark, 40, 3000)
    one, other = (
        {r["key"]: (r["b0"], r["b_0"], r["converged"]) for r in logit_by_key(df, ["key"], "s", "n", ["x"], broadcast_keys=b).collect()}
        for b in (0, 10_000)
    )
    assert set(one) == set(other) and all(c for _, _, c in one.values())
    for key, (b0, b_0, _) in one.items():
        assert math.isclose(b0, other[key][0], rel_tol=1e-9, abs_tol=1e-10)
        assert math.isclose(b_0, other[key][1], rel_tol=1e-9, abs_tol=1e-10)
