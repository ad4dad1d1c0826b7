"""Exact quantiles of every group by narrowing counted bins.

A group's values never meet: each round deals the values of the ranges still searched into bins, counts
them with map-side combination, and goes on in the bin that holds the wanted rank. What a group
needs is a row for each bin and wanted rank, however many values it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage, small_side

BINS = 1024
#: A range with so few values is sorted as one array.
LEAF = 4096


def _position(n: str, q: float) -> Column:
    """Place of a quantile among ``n`` sorted values, from 0."""
    return (F.col(n) - 1) * F.lit(float(q))


def _bin(bins: int, by_size: bool) -> Column:
    """Bin of ``v`` in its range, even in the values or in their order of size.

    The ends lie in the first and the last one. Halves cannot overflow; 746 is beyond the logarithm of any
    double, so sizes keep the order of the values.
    """
    v, lo, hi = (F.col(c) / 2 for c in ("v", "lo", "hi"))
    even = (v - lo) / (hi - lo)
    if by_size:
        v, lo, hi = (F.when(F.col(c) != 0, F.signum(c) * (F.ln(F.abs(c)) + 746)).otherwise(0.0) for c in ("v", "lo", "hi"))
        even = F.coalesce(F.try_divide(v - lo, hi - lo), even)
    return F.least(F.lit(bins - 1), F.floor(even * bins)).cast("int")


def _equal(names: Sequence[str]) -> Column:
    """Equal columns of the sides ``a`` and ``b``, nulls included."""
    return reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names], F.lit(True))


def _present(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    rows = df.select(*keys, F.col(value).cast("double").alias("v"))
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v"))


def _in_ranges(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of the ranges still searched; the ranges, a few a group, are counted before they are broadcast."""
    ranges = small_side(state.select(*keys, "lo", "hi").distinct())
    within = (F.col("a.v") >= F.col("b.lo")) & (F.col("a.v") <= F.col("b.hi"))
    met = rows.alias("a").join(ranges.alias("b"), _equal(keys) & within)
    return met.select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.v", "b.lo", "b.hi")


def _narrowed(rows: DataFrame, state: DataFrame, keys: Sequence[str], bins: int, by_size: bool) -> DataFrame:
    """Every wanted rank in the bin that holds it."""
    counted = (
        _in_ranges(rows, state, keys)
        .groupBy(*keys, "lo", "hi", _bin(bins, by_size).alias("bin"))
        .agg(F.count("v").alias("n_in"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"))
    )
    earlier = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("skipped", F.coalesce(F.sum("n_in").over(earlier), F.lit(0)))
    place = F.col("a.rank") - F.col("a.before") - F.col("b.skipped")
    holds = (place >= 0) & (place < F.col("b.n_in"))
    return state.alias("a").join(counted.alias("b"), _equal([*keys, "lo", "hi"]) & holds).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.col("b.bin_lo").alias("lo"),
        F.col("b.bin_hi").alias("hi"),
        F.col("b.n_in").alias("n_in"),
        (F.col("a.before") + F.col("b.skipped")).alias("before"),
        F.col("a.rank").alias("rank"),
    )


def _from_leaves(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wanted ranks of ranges with few values, from these sorted."""
    arrays = _in_ranges(rows, state, keys).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("values"))
    value = F.get(F.col("b.values"), (F.col("a.rank") - F.col("a.before")).cast("int"))
    return state.alias("a").join(arrays.alias("b"), _equal([*keys, "lo", "hi"])).select(
        *[F.col(f"a.{k}").alias(k) for k in keys], "a.rank", value.alias("value")
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], bins: int = BINS, leaf: int = LEAF
) -> DataFrame:
    """``keys, n, marks``: the interpolated quantiles that ``percentile`` gives, in the order asked for.

    Null and NaN values do not count; a group without any other value is not listed. A range of equal
    values is settled. Rounds end because the smallest and the largest value of a range lie in different
    bins; even bins alternate with bins by size, so values of any spread need few rounds: about one for
    every factor ``bins`` between a group's rows and ``leaf``.
    """
    rows = cut_lineage(_present(df, keys, value))
    sizes = cut_lineage(
        rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n_in"))
    )
    ranks = F.array_distinct(F.array(*[f(_position("n_in", q)).cast("long") for q in quantiles for f in (F.floor, F.ceil)]))
    state = sizes.select(*keys, "lo", "hi", "n_in", F.lit(0).cast("long").alias("before"), F.explode(ranks).alias("rank"))
    settled = [state.where("lo = hi")]
    leaves = []
    while True:
        leaves.append(state.where(f"lo < hi AND n_in <= {leaf}"))
        state = state.where(f"lo < hi AND n_in > {leaf}")
        if state.isEmpty():
            break
        state = cut_lineage(_narrowed(rows, state, keys, bins, by_size=len(leaves) % 2 == 0))
        settled.append(state.where("lo = hi"))
    found = [part.select(*keys, "rank", F.col("lo").alias("value")) for part in settled]
    found.append(_from_leaves(rows, reduce(DataFrame.unionByName, leaves), keys))
    listed = (
        reduce(DataFrame.unionByName, found)
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values"))
    )

    def mark(q: float) -> Column:
        place = _position("n_in", q)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        below, above = F.element_at("values", low), F.element_at("values", high)
        return F.when(below == above, below).otherwise((high - place) * below + (place - low) * above)

    joined = sizes.alias("a").join(listed.alias("b"), _equal(keys))
    return joined.select(
        *[F.col(f"a.{k}").alias(k) for k in keys], F.col("n_in").alias("n"), F.array(*map(mark, quantiles)).alias("marks")
    )
