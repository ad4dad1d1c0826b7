"""Moments and least squares against NumPy on small literal tables."""

import math

import numpy as np
import pytest
from panelcast.operators.holdout import holdout_fits, holdout_pooled_slopes
from panelcast.operators.moments import Formula, moments, total_moments
from panelcast.operators.ols import (
    correlation,
    ols_by_key,
    pooled_ols,
    predict,
    residuals,
    slope_tests,
)

F3 = Formula("m", "y", ("a", "b", "c"))
F1 = Formula("one", "y", ("a",))


def panel(seed=7, keys=4, rows=12):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(keys):
        for t in range(rows):
            a, b, c = rng.normal(50 + 10 * k, 3), rng.normal(), float(rng.integers(0, 2))
            out.append((f"k{k}", 2000 + t, float(a), float(b), c, float(2 * k + 0.4 * a - b + 3 * c + rng.normal())))
    return out


SCHEMA = "key STRING, year INT, a DOUBLE, b DOUBLE, c DOUBLE, y DOUBLE"


def design(rows, xs=(2, 3, 4)):
    x = np.array([[1.0, *[r[i] for i in xs]] for r in rows])
    return x, np.array([r[5] for r in rows])


def lstsq(rows, xs=(2, 3, 4)):
    x, y = design(rows, xs)
    return np.linalg.lstsq(x, y, rcond=None)[0]


def coefficients(row, f=F3):
    return [row[f"{f.name}_b0"], *[row[f"{f.name}_b_{i}"] for i in range(f.k)]]


def test_by_key_equals_numpy(spark):
    rows = panel()
    fits = ols_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], [F3, F1]).collect()
    assert len(fits) == 4
    for fit in fits:
        mine = [r for r in rows if r[0] == fit["key"]]
        x, y = design(mine)
        beta = lstsq(mine)
        assert np.allclose(coefficients(fit), beta, rtol=1e-9)
        assert np.allclose(coefficients(fit, F1), lstsq(mine, (2,)), rtol=1e-9)
        sse = float(((y - x @ beta) ** 2).sum())
        sst = float(((y - y.mean()) ** 2).sum())
        assert math.isclose(fit["m_mse"], sse / len(y), rel_tol=1e-9)
        assert math.isclose(fit["m_r2"], 1 - sse / sst, rel_tol=1e-9)
        assert math.isclose(fit["m_adj_r2"], 1 - sse / sst * (len(y) - 1) / (len(y) - 4), rel_tol=1e-9)
        assert fit["m_df"] == 8 and fit["m_terms"] == 4


@pytest.mark.parametrize(("offset", "identified"), [(1e7, True), (1e9, False)])
def test_large_offset_keeps_digits(spark, offset, identified):
    """Centred sums stay exact; beyond a relative spread of 1e-7 a predictor counts as constant."""
    rows = [("k", 1, offset + i, 0.0, 0.0, 3.0 * i + (i % 2)) for i in range(50)]
    fit = ols_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], [F1]).first()
    if not identified:
        assert fit["one_b_0"] is None
        return
    slope = np.polyfit(np.arange(50), [r[5] for r in rows], 1)[0]
    assert math.isclose(fit["one_b_0"], slope, rel_tol=1e-8)


def test_listwise_deletion_is_per_formula(spark):
    rows = [
        ("k", 1, 1.0, None, 0.0, 2.0),
        ("k", 2, 2.0, 1.0, 0.0, 3.0),
        ("k", 3, 3.0, 2.0, 1.0, 5.0),
        ("k", 4, None, 2.0, 1.0, 9.0),
        ("k", 5, 5.0, 7.0, 0.0, None),
    ]
    row = moments(spark.createDataFrame(rows, SCHEMA), ["key"], [F3, F1]).first()
    assert row["m_n"] == 2 and row["one_n"] == 3
    assert math.isclose(row["one_mean_1"], (2 + 3 + 5) / 3)


def test_short_samples_and_aliased_terms(spark):
    rows = [
        ("single", 1, 1.0, 1.0, 1.0, 4.0),
        *[("constant", t, float(t), 5.0, float(t % 2), 2.0 * t + t % 2) for t in range(6)],
        *[("duplicate", t, float(t), 3.0 * t + 1, float(t % 2), 7.0 - t) for t in range(6)],
        *[("two", t, float(t), float(t * t), 0.0, 1.0 + t) for t in range(2)],
        ("empty", 1, None, 1.0, 1.0, 4.0),
    ]
    got = {
        r["key"]: r
        for r in ols_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], [F3]).collect()
    }
    assert got["single"]["m_terms"] == 1 and got["single"]["m_b0"] == 4.0
    assert got["single"]["m_df"] == 0 and got["single"]["m_r2"] is None
    assert got["constant"]["m_b_1"] is None and got["constant"]["m_terms"] == 3
    assert math.isclose(got["constant"]["m_b_0"], 2.0, rel_tol=1e-9)
    assert got["duplicate"]["m_b_1"] is None
    assert math.isclose(got["duplicate"]["m_b_0"], -1.0, rel_tol=1e-9)
    # with two rows only the first predictor can be told from the intercept
    assert got["two"]["m_terms"] == 2 and math.isclose(got["two"]["m_b_0"], 1.0)
    assert got["empty"]["m_n"] == 0 and got["empty"]["m_b0"] is None


def test_perfect_fit(spark):
    rows = [("k", t, float(t), 0.0, 0.0, 3.0 + 2.0 * t) for t in range(8)]
    fit = ols_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], [F1]).first()
    assert fit["one_sse"] < 1e-18 and math.isclose(fit["one_r2"], 1.0)


def test_interval_of_the_mean(spark):
    rows = panel(keys=1)
    df = spark.createDataFrame(rows, SCHEMA)
    fits = ols_by_key(df, ["key"], [F3])
    score = spark.createDataFrame([("k0", 51.0, 0.3, 1.0)], "key STRING, a DOUBLE, b DOUBLE, c DOUBLE")
    got = predict(score.join(fits, "key"), [F3], 0.95).first()
    x, y = design(rows)
    beta = lstsq(rows)
    x0 = np.array([1.0, 51.0, 0.3, 1.0])
    s2 = ((y - x @ beta) ** 2).sum() / 8
    half = 2.306004135 * math.sqrt(s2 * x0 @ np.linalg.inv(x.T @ x) @ x0)
    assert math.isclose(got["m_fit"], x0 @ beta, rel_tol=1e-9)
    assert math.isclose(got["m_upr"] - got["m_fit"], half, rel_tol=1e-8)
    assert math.isclose(got["m_fit"] - got["m_lwr"], half, rel_tol=1e-8)


def test_no_interval_without_degrees_of_freedom(spark):
    rows = panel(keys=1, rows=4)
    fits = ols_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], [F3])
    got = predict(spark.createDataFrame(rows[:1], SCHEMA).join(fits, "key"), [F3], 0.95).first()
    assert got["m_fit"] is not None and got["m_lwr"] is None and got["m_upr"] is None


def _dummies(rows):
    keys = sorted({r[0] for r in rows})
    x = np.array([[*[float(r[0] == k) for k in keys], r[2], r[3], r[4]] for r in rows])
    return keys, x, np.array([r[5] for r in rows])


def test_pooled_equals_explicit_dummies(spark):
    rows = [r for r in panel() if not (r[0] == "k2" and r[1] > 2004)]
    df = spark.createDataFrame([("g", *r) for r in rows], "grp STRING, " + SCHEMA)
    fits = {r["key"]: r for r in pooled_ols(df, ["grp", "key"], ["grp"], [F3]).collect()}
    keys, x, y = _dummies(rows)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    sse = ((y - x @ beta) ** 2).sum()
    for i, k in enumerate(keys):
        assert np.allclose(
            coefficients(fits[k]), [beta[i], *beta[len(keys):]], rtol=1e-8
        )
        assert math.isclose(fits[k]["m_mse"], sse / len(y), rel_tol=1e-9)
        assert math.isclose(fits[k]["m_r2"], 1 - sse / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
        assert fits[k]["m_df"] == len(y) - len(keys) - 3
    scored = predict(
        df.filter("year = 2003").join(pooled_ols(df, ["grp", "key"], ["grp"], [F3]), ["grp", "key"]),
        [F3],
        0.95,
        pooled=True,
    ).collect()
    inverse = np.linalg.inv(x.T @ x)
    for row in scored:
        x0 = np.array([*[float(row["key"] == k) for k in keys], row["a"], row["b"], row["c"]])
        se = math.sqrt(sse / row["m_df"] * x0 @ inverse @ x0)
        assert math.isclose(row["m_fit"], x0 @ beta, rel_tol=1e-9)
        ratio = (row["m_upr"] - row["m_fit"]) / se
        assert 1.96 < ratio < 2.06


def test_holdouts_equal_refits(spark):
    rows = panel(keys=3, rows=10) + panel(seed=9, keys=3, rows=10)
    df = spark.createDataFrame(rows, SCHEMA)
    for fit in holdout_fits(df, ["key"], "year", [F3]).collect():
        rest = [r for r in rows if r[0] == fit["key"] and r[1] != fit["year"]]
        assert np.allclose(coefficients(fit), lstsq(rest), rtol=1e-7)
        assert fit["m_n"] == len(rest)


def test_holdout_that_leaves_a_constant_predictor(spark):
    rows = [("k", t, float(t), float(t * t % 5), float(t == 4), 2.0 * t + t % 3) for t in range(9)]
    fits = holdout_fits(spark.createDataFrame(rows, SCHEMA), ["key"], "year", [F3]).collect()
    by_year = {r["year"]: r for r in fits}
    assert by_year[4]["m_b_2"] is None and by_year[4]["m_terms"] == 3
    rest = [r for r in rows if r[1] != 4]
    assert np.allclose(coefficients(by_year[4])[:3], lstsq(rest, (2, 3)), rtol=1e-8)
    assert by_year[3]["m_b_2"] is not None


def test_holdout_of_the_only_period(spark):
    rows = [("k", 1, 1.0, 2.0, 0.0, 3.0)]
    fit = holdout_fits(spark.createDataFrame(rows, SCHEMA), ["key"], "year", [F3]).first()
    assert fit["m_n"] == 0 and fit["m_b0"] is None


def test_pooled_holdout_slopes_equal_refits(spark):
    rows = [r for r in panel(rows=8) if not (r[0] == "k1" and r[1] == 2002)]
    df = spark.createDataFrame([("g", *r) for r in rows], "grp STRING, " + SCHEMA)
    totals = total_moments(moments(df, ["grp", "key", "year"], [F3]), ["grp", "key"], [F3])
    got = holdout_pooled_slopes(totals, ["grp", "key"], ["grp"], "year", [F3]).collect()
    assert len(got) == 8
    for row in got:
        keys, x, y = _dummies([r for r in rows if r[1] != row["year"]])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose([row[f"m_b_{i}"] for i in range(3)], beta[len(keys):], rtol=1e-7)


def test_residuals_sum_to_zero(spark):
    df = spark.createDataFrame(panel(), SCHEMA)
    out = residuals(df, ols_by_key(df, ["key"], [F3]), ["key"], [F3])
    sums = out.groupBy("key").sum("m_residual").collect()
    assert out.count() == 48 and all(abs(r[1]) < 1e-9 for r in sums)


def test_correlation_of_a_constant_is_null(spark):
    rows = [("flat", t, 5.0, 0.0, 0.0, float(t)) for t in range(4)]
    rows += [("rising", t, float(t), 0.0, 0.0, 2.0 * t) for t in range(4)]
    fits = ols_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], [F1])
    got = {r["key"]: r["c"] for r in fits.select("key", correlation(F1).alias("c")).collect()}
    assert got["flat"] is None and math.isclose(got["rising"], 1.0)


def test_slope_p_value(spark):
    # y on x for 10 points: slope t = 3.0152, 8 degrees of freedom
    x = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    y = [2.0, 1.0, 4.0, 3.0, 7.0, 2.0, 8.0, 5.0, 6.0, 9.0]
    rows = [("k", 0, float(a), 0.0, 0.0, b) for a, b in zip(x, y, strict=True)]
    row = slope_tests(ols_by_key(spark.createDataFrame(rows, SCHEMA), ["key"], [F1]), F1).first()
    t = row["one_t_0"]
    theta = math.atan(t / math.sqrt(8))
    c2 = math.cos(theta) ** 2
    series = 1 + c2 / 2 + 3 * c2**2 / 8 + 15 * c2**3 / 48
    assert math.isclose(row["one_p_0"], 1 - math.sin(theta) * series, rel_tol=1e-10)


@pytest.mark.parametrize("parts", [1, 16])
def test_hot_key_and_partitioning_do_not_change_the_fit(spark, parts):
    rows = panel(keys=3, rows=10) + [("hot", *r[1:]) for r in panel(seed=3, keys=1, rows=3000)]
    fits = ols_by_key(spark.createDataFrame(rows, SCHEMA).repartition(parts), ["key"], [F3])
    hot = fits.filter("key = 'hot'").first()
    assert np.allclose(coefficients(hot), lstsq([r for r in rows if r[0] == "hot"]), rtol=1e-8)
