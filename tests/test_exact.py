"""Order-independent sums against rational numbers."""

import math
import random
from fractions import Fraction

import pytest
from panelcast.operators.exact import exact_sums
from pyspark.sql import functions as F


def groups():
    rng = random.Random(9)
    out = {
        "prices": [round(rng.uniform(1, 500_000), 2) for _ in range(800)],
        "cancel": [1e300, 1.0, -1e300, 1e-300, 3.0, -0.0],
        "wide": [rng.choice([-1, 1]) * math.ldexp(rng.random(), rng.randrange(-1073, 1000)) for _ in range(600)],
        "tiny": [5e-324, 5e-324, -1.5e-323, 2.5e-320, 2**-1040, 2**-1022, -(2**-1041)],
        "powers": [s * 2.0**e for e in range(-1074, 1023, 7) for s in (1, -1, 1)],
        "borders": [2.0 ** (40 * b) * f for b in range(-26, 25) for f in (1 - 2**-53, 1.0, 1 + 2**-52)],
        "over": [1.7e308, 1.7e308],
        "back": [1.7e308, 1.7e308, -1.7e308],
        "nan": [1.0, math.nan],
        "inf": [1.0, math.inf],
        "minus": [-math.inf, 2.0],
        "both": [math.inf, -math.inf],
        "none": [None, None],
        "zero": [0.0, -0.0],
        None: [0.1] * 10,
    }
    return out


def expected(values):
    known = [v for v in values if v is not None]
    if not known:
        return None
    if any(not math.isfinite(v) for v in known):
        return sum(known)
    try:
        return float(sum(map(Fraction, known)))
    except OverflowError:
        return math.inf


def rows():
    listed = [(k, v, 1.5) for k, values in groups().items() for v in values]
    random.Random(1).shuffle(listed)
    return listed


@pytest.mark.parametrize("parts", [1, 64])
def test_sums_are_exact_under_any_partitioning(spark, parts):
    df = spark.createDataFrame(rows(), "k STRING, v DOUBLE, w DOUBLE").repartition(parts)
    got = {r["k"]: r for r in exact_sums(df, ["k"], ["v", "w"]).collect()}
    assert set(got) == set(groups())
    for k, values in groups().items():
        want, r = expected(values), got[k]
        same = r["v_sum"] is None if want is None else (math.isnan(r["v_sum"]) if math.isnan(want) else r["v_sum"] == want)
        assert same, (k, r["v_sum"], want)
        assert r["v_n"] == sum(v is not None for v in values)
        assert r["w_sum"] == 1.5 * len(values) and r["w_n"] == len(values)


def test_whole_and_empty_tables(spark):
    df = spark.range(1000).select((F.col("id") * 0.1).alias("v"))
    assert exact_sums(df, [], ["v"]).first()[0] == float(sum(Fraction(i * 0.1) for i in range(1000)))
    assert exact_sums(df.limit(0).withColumn("k", F.lit(1)), ["k"], ["v"]).collect() == []
