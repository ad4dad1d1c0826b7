"""Sums of doubles that do not depend on the order of the rows, to the last bit.

Every double is split, without rounding, into whole multiples of 2 to the power of 40 b; multiples of one b are added
as integers with map-side combination, and only the few integers of a group are put together at the
end, rounded once. So 1 or 1,000 partitions, retries and any order of rows give the same bits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 40
#: Bins of the smallest and the largest doubles; the lowest one counts the smallest double itself.
_LOWEST, _HIGHEST = -27, 25
_LEAST = 1074
#: Bins of entries that are counts: values, not-a-numbers, infinities of either sign.
_VALUES, _NAN, _PLUS, _MINUS = 100, 101, 102, 103


def _unit(b: Column) -> Column:
    return F.when(b == _LOWEST, F.lit(5e-324)).otherwise(F.pow(F.lit(2.0), b * WIDTH))


def _entries(column: str, index: int) -> Column:
    """(column, bin, amount) of one value; null values have none."""
    x = F.col(column).cast("double")
    entry = lambda b, amount: F.struct(
        F.lit(index).alias("column"), b.cast("int").alias("bin"), amount.cast("decimal(18,0)").alias("amount")
    )
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    # the logarithm may be a little off, so the first of four bins is one above it
    top = F.greatest(F.least(F.floor(F.log2(F.abs(x)) / WIDTH) + 1, F.lit(_HIGHEST)), F.lit(_LOWEST + 3)).cast("int")

    def split(first: Column) -> Column:
        rest, parts = x, []
        for i in range(4):
            unit = _unit(first - i)
            whole = F.when(rest < 0, F.ceil(rest / unit)).otherwise(F.floor(rest / unit))
            parts.append(entry(first - i, whole))
            rest = rest - whole.cast("double") * unit
        return F.array(*parts)

    limbs = F.when(finite & (x != 0), F.transform(F.array(top), split)[0]).otherwise(F.array().cast(
        "array<struct<column:int,bin:int,amount:decimal(18,0)>>"
    ))
    odd = F.when(F.isnan(x), _NAN).when(x == float("inf"), _PLUS).when(x == float("-inf"), _MINUS).otherwise(_VALUES)
    one = F.lit(1)
    known = F.concat(F.filter(limbs, lambda e: e["amount"] != 0), F.array(entry(F.lit(_VALUES), one)))
    return F.when(x.isNull(), F.array().cast("array<struct<column:int,bin:int,amount:decimal(18,0)>>")).otherwise(
        F.when(odd != _VALUES, F.concat(known, F.array(entry(odd, one)))).otherwise(known)
    )


def put_together(parts: Sequence[tuple[int, int]]) -> tuple[float | None, int]:
    """The sum of bins and amounts, rounded once, and the number of values."""
    amounts = dict(parts)
    n = amounts.get(_VALUES, 0)
    if not n:
        return None, 0
    if _NAN in amounts or (_PLUS in amounts and _MINUS in amounts):
        return math.nan, n
    if _PLUS in amounts or _MINUS in amounts:
        return math.inf if _PLUS in amounts else -math.inf, n
    total = 0
    for b, amount in amounts.items():
        if b <= _HIGHEST:
            total += amount << (0 if b == _LOWEST else WIDTH * b + _LEAST)
    try:
        return total / (1 << _LEAST), n
    except OverflowError:
        return math.inf if total > 0 else -math.inf, n


def exact_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keys`` with ``c_sum`` and ``c_n`` of every column: the exact sum, rounded once, and the values in it.

    A group without a value has a NULL sum. Infinities and not-a-numbers give what adding them gives.
    """
    listed = F.concat(*[_entries(c, i) for i, c in enumerate(columns)])
    rows = df.select(*keys, F.explode_outer(listed).alias("__e"))
    added = rows.groupBy(*keys, F.col("__e.column").alias("__column"), F.col("__e.bin").alias("__bin")).agg(
        F.sum("__e.amount").cast("string").alias("__amount")
    )
    few = added.groupBy(*keys).agg(F.collect_list(F.struct("__column", "__bin", "__amount")).alias("__parts"))
    # sums travel as text, since pandas makes no difference between NaN and null
    fields = ", ".join(f"`{c}_sum` string, `{c}_n` long" for c in columns)
    count = len(columns)

    @F.pandas_udf(fields)
    def rounded(parts: pd.Series) -> pd.DataFrame:
        out = []
        for listed in parts:
            own = [[] for _ in range(count)]
            for part in listed:
                if part["__column"] is not None:
                    own[part["__column"]].append((part["__bin"], int(part["__amount"])))
            sums = [put_together(one) for one in own]
            out.append([v for total, n in sums for v in (None if total is None else repr(total), n)])
        return pd.DataFrame(out, columns=[f"{c}_{s}" for c in columns for s in ("sum", "n")])

    found = [F.col(f"__r.`{c}_sum`").cast("double").alias(f"{c}_sum") for c in columns]
    found = [x for c, total in zip(columns, found, strict=True) for x in (total, F.col(f"__r.`{c}_n`"))]
    return few.select(*keys, rounded("__parts").alias("__r")).select(*keys, *found)
