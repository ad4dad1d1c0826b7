"""Equal-width histograms per facet."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import cut_lineage, small_side


def histogram(df: DataFrame, facets: Sequence[str], value: str, bins: int) -> DataFrame:
    """``bins`` half-open bins over each facet's own range, the last one closed.

    A facet whose values are all equal has one bin; empty bins are not listed. The
    ranges, one row per facet, are counted before they are broadcast, so rows are
    binned where they are and only counts are shuffled. ``df`` is read twice: hand
    over something written when it is expensive.
    """
    present = df.filter(F.col(value).isNotNull()).select(*facets, F.col(value).cast("double").alias(value))
    ranges = present.groupBy(*facets).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    ranges = small_side(ranges.withColumn("width", width))
    position = F.floor(F.try_divide(F.col(value) - F.col("lo"), F.col("width"))) + 1
    return (
        present.join(ranges, list(facets))
        .withColumn("bin", F.least(F.lit(bins), F.coalesce(position, F.lit(1))).cast("int"))
        .groupBy(*facets, "lo", "width", "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            *facets,
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("bin_from"),
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_to"),
            "rows",
        )
    )


def width_exponent(lo: float, hi: float, bins: int) -> int:
    """Least k for which bins of width 2**k at multiples of 2**k cover ``lo`` to ``hi`` with at most ``bins``.

    Never so fine that a bin number would leave 53 bits.
    """
    least = max(math.frexp(max(abs(lo), abs(hi)))[1] - 53, -1020)
    spread = hi / 2 - lo / 2
    k = max(least, math.frexp(spread)[1] - bins.bit_length()) if spread > 0 else least
    while _place(hi, k) - _place(lo, k) + 1 > bins:
        k += 1
    return k


def _place(v: float, k: int) -> int:
    return math.floor(math.ldexp(v, -k))


class _Bins:
    """Counts in bins of width 2**k, which doubles when the values no longer fit."""

    def __init__(self, bins: int):
        self.bins, self.k, self.lo, self.hi = bins, None, math.inf, -math.inf
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.lo, self.hi = min(self.lo, values.min()), max(self.hi, values.max())
        k = width_exponent(self.lo, self.hi, self.bins)
        old = self.at >> min(k - self.k, 63) if self.k is not None else self.at
        new = np.floor(np.ldexp(values, -k)).astype(np.int64)
        self.at, where = np.unique(np.concatenate([old, new]), return_inverse=True)
        self.n = np.bincount(where, np.concatenate([self.n, np.ones(len(new), np.int64)])).astype(np.int64)
        self.k = k


def doubling_histogram(df: DataFrame, facets: Sequence[str], value: str, bins: int) -> DataFrame:
    """At most ``bins`` bins per facet, of the least power of two as width, from one scan.

    Each task counts a facet in at most ``bins`` bins and doubles their width when values
    no longer fit, two bins becoming one; facets of different tasks merge the same way, so the result
    depends on the values alone. Only counts are shuffled, and nothing but counts is written. Null,
    NaN and infinite values do not count; empty bins are not listed.
    """
    rows = df.select(*facets, F.col(value).cast("double").alias("__v"))
    rows = rows.where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    schema = T.StructType([rows.schema[f] for f in facets])
    for name, kind in (("__k", T.IntegerType()), ("__at", T.LongType()), ("__n", T.LongType()), ("__lo", T.DoubleType()), ("__hi", T.DoubleType())):
        schema.add(name, kind)
    names = list(facets)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, _Bins] = {}
        for batch in batches:
            if batch.empty:
                continue
            batch = batch.astype({f: object for f in names})
            batch[names] = batch[names].where(batch[names].notna(), None)
            groups = batch.groupby(names, dropna=False, sort=False)["__v"] if names else [((), batch["__v"])]
            for key, values in groups:
                key = tuple(None if pd.isna(x) else x for x in key)
                held.setdefault(key, _Bins(bins)).add(values.to_numpy(dtype=float))
        for key, one in held.items():
            out = pd.DataFrame({f: pd.Series([x] * len(one.at), dtype=object) for f, x in zip(names, key, strict=True)})
            yield out.assign(__k=one.k, __at=one.at, __n=one.n, __lo=one.lo, __hi=one.hi)

    @F.pandas_udf("int")
    def width(lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([width_exponent(a, b, bins) for a, b in zip(lo, hi, strict=True)], dtype="int32")

    parts = cut_lineage(rows.mapInPandas(count, schema))
    ranges = parts.groupBy(*facets).agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    ranges = ranges.select(*facets, width("__lo", "__hi").alias("__width"))
    same = reduce(Column.__and__, [F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in facets], F.lit(True))
    merged = parts.alias("a").join(ranges.alias("b"), same)
    bin_from = F.expr("shiftright(a.__at, least(b.__width - a.__k, 63))").alias("__bin")
    counted = merged.groupBy(*[F.col(f"a.{f}").alias(f) for f in facets], "b.__width", bin_from).agg(F.sum("a.__n").alias("rows"))
    unit = F.pow(F.lit(2.0), F.col("__width"))
    return counted.select(
        *facets, (F.col("__bin") * unit).alias("bin_from"), ((F.col("__bin") + 1) * unit).alias("bin_to"), "rows"
    )
