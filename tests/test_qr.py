"""Fits by merged triangular factors against NumPy."""

import math

import numpy as np
import pytest

from panelcast.operators.qr import qr_fits

K = 10
SCHEMA = "key STRING, " + ", ".join(f"x{i} DOUBLE" for i in range(K)) + ", y DOUBLE, n DOUBLE"


def rows():
    rng = np.random.default_rng(4)
    out = []
    for key, count in (("a", 40), ("b", 200), (None, 30), ("hot", 900)):
        x = rng.normal(size=(count, K)) * 10.0 ** np.arange(-3, K - 3) + 5
        y = x @ rng.normal(size=K) + rng.normal(size=count) * 50
        out += [(key, *map(float, a), float(b), 0.0) for a, b in zip(x, y, strict=True)]
    return out


def expected(part):
    x = np.array([[1.0, *r[1 : K + 1]] for r in part])
    y = np.array([r[K + 1] for r in part])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    sse, sst = ((y - x @ b) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    cov = np.linalg.inv(x.T @ x) * sse / (len(y) - K - 1)
    return b, sse, sst, np.sqrt(np.diag(cov))


@pytest.mark.parametrize("parts", [1, 9])
def test_ten_predictors_per_key(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    xs = [f"x{i}" for i in range(K)]
    got = {r["key"]: r for r in qr_fits(df, ["key"], "y", xs).collect()}
    assert set(got) == {"a", "b", None, "hot"}
    for key, r in got.items():
        part = [x for x in data if x[0] == key]
        b, sse, sst, errors = expected(part)
        assert np.allclose([r["intercept"], *r["coefficients"]], b, rtol=1e-7, atol=1e-9)
        assert np.allclose(r["errors"], errors[1:], rtol=1e-6)
        assert (r["n"], r["terms"], r["df"]) == (len(part), K + 1, len(part) - K - 1)
        assert math.isclose(r["sse"], sse, rel_tol=1e-9) and math.isclose(r["sst"], sst, rel_tol=1e-9)
        assert math.isclose(r["r2"], 1 - sse / sst, rel_tol=1e-9)


@pytest.mark.parametrize("offset", [1e7, 1e9, 1e11])
def test_large_offsets_keep_their_digits(spark, offset):
    data = [("k", offset + i, 3.0 * i + (i % 2)) for i in range(50)]
    r = qr_fits(spark.createDataFrame(data, "key STRING, x DOUBLE, y DOUBLE"), ["key"], "y", ["x"], 1e-13).first()
    slope = np.polyfit(np.arange(50), [d[2] for d in data], 1)[0]
    assert math.isclose(r["coefficients"][0], slope, rel_tol=1e-16 * offset * 10 + 1e-10)


def test_aliased_short_and_incomplete(spark):
    data = [("c", float(i), 2.0 * i + 1, 5.0, float(i % 3), 1.0 * i + (i % 2)) for i in range(20)]
    data += [("one", 1.0, 2.0, 3.0, 4.0, 5.0), ("two", 1.0, 2.0, 3.0, 4.0, 5.0), ("two", 2.0, 2.0, 3.0, 4.0, 7.0)]
    data += [("gap", None, 1.0, 1.0, 1.0, 1.0), ("gap", math.nan, 1.0, 1.0, 1.0, 1.0), ("zero", 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "key STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, y DOUBLE")
    got = {r["key"]: r for r in qr_fits(df, ["key"], "y", ["a", "b", "c", "d"]).collect()}
    assert set(got) == {"c", "one", "two", "zero"}
    assert [v is None for v in got["c"]["coefficients"]] == [False, True, True, False] and got["c"]["terms"] == 3
    assert got["one"]["intercept"] == pytest.approx(5.0) and got["one"]["r2"] is None and got["one"]["coefficients"] == [None] * 4
    assert got["two"]["coefficients"][0] == pytest.approx(2.0) and got["two"]["df"] == 0 and got["two"]["errors"][0] is None
    assert got["zero"]["intercept"] == 0.0
    assert qr_fits(df.limit(0), ["key"], "y", ["a"]).collect() == []
    assert qr_fits(df, [], "y", ["a"]).first()["n"] == 24


def test_one_shuffle_and_a_plan_that_does_not_grow(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    plans = [
        qr_fits(data, ["key"], "y", [f"x{i}" for i in range(k)])._jdf.queryExecution().executedPlan().toString() for k in (1, K)
    ]
    assert all(p.count("Exchange") == 1 for p in plans)
    assert len({len(p.splitlines()) for p in plans}) == 1
