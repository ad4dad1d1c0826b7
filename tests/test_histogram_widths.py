"""Histograms whose bins double, against counting with the widths known."""

import collections
import math
import random

import pytest
from panelcast.operators.histogram import doubling_histogram, width_exponent


def groups():
    rng = random.Random(6)
    return {
        "even": [rng.uniform(-50, 1000) for _ in range(900)],
        "far": [1e15 + rng.random() for _ in range(50)],
        "spread": [rng.choice([-1, 1]) * 10 ** rng.uniform(-5, 12) for _ in range(400)],
        "same": [3.25] * 40,
        "zero": [0.0, -0.0],
        "odd": [None, math.nan, math.inf, 1.0, 9.0],
        "none": [None],
        "wide": [-1.5e308, 1.5e308],
        None: [1.0, 2.0, 70.0],
    }


@pytest.mark.parametrize("parts", [1, 13])
@pytest.mark.parametrize("bins", [10, 64])
def test_counts_depend_on_the_values_alone(spark, parts, bins):
    rows = [(k, v) for k, values in groups().items() for v in values]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(parts)
    got = collections.defaultdict(dict)
    for r in doubling_histogram(df, ["k"], "v", bins).collect():
        got[r["k"]][r["bin_from"], r["bin_to"]] = r["rows"]
    expected = {}
    for k, values in groups().items():
        values = [v for v in values if v is not None and math.isfinite(v)]
        if values:
            w = 2.0 ** width_exponent(min(values), max(values), bins)
            expected[k] = dict(collections.Counter((math.floor(v / w) * w, (math.floor(v / w) + 1) * w) for v in values))
            assert len(expected[k]) <= bins
    assert got == expected


def test_widths_are_the_least(spark):
    for lo, hi, bins in ((0.0, 10.0, 10), (-3.0, 1000.0, 64), (0.1, 0.2, 7), (5.0, 5.0, 3)):
        k = width_exponent(lo, hi, bins)
        span = lambda k, lo=lo, hi=hi: math.floor(hi / 2.0**k) - math.floor(lo / 2.0**k) + 1
        assert span(k) <= bins and (lo == hi or span(k - 1) > bins)


def test_one_scan_and_empty_tables(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id * 1.5 AS v")
    assert sum(r["rows"] for r in doubling_histogram(df, [], "v", 8).collect()) == 100
    assert doubling_histogram(df.limit(0), ["k"], "v", 8).collect() == []
    plan = doubling_histogram(df, ["k"], "v", 8)._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan.replace("rangepartitioning", "")
