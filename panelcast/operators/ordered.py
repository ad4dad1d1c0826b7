"""Lags and positions over groups of any length, in blocks of a total order.

A bounded sample gives the values at which an order is cut into blocks of even size. Every row finds its block
by halving steps over these, so one shuffle brings a block together, in as many tasks as
there are blocks, whether the rows belong to one group or to millions. Counts of the blocks turn
places in a block into places in the whole order; the few rows at the edges of blocks are carried over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

BLOCK_ROWS = 1_000_000
#: Sampled rows for each block: blocks are then even to within about a third.
_SAMPLED = 50


def _nulls_first(row: Sequence) -> tuple:
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


def splitters(df: DataFrame, orders: Mapping[str, Sequence[str]], block_rows: int) -> dict[str, list[tuple]]:
    """For each order the rows that start its second and further blocks, all from one sample."""
    blocks = -(-df.count() // block_rows)
    if blocks <= 1:
        return {name: [] for name in orders}
    columns = list(dict.fromkeys(c for order in orders.values() for c in order))
    sample = df.select(*columns).sample(min(1.0, _SAMPLED / block_rows), seed=11).collect()
    found = {}
    for name, order in orders.items():
        ranked = sorted((tuple(row[c] for c in order) for row in sample), key=_nulls_first)
        marks = [ranked[len(ranked) * i // blocks] for i in range(1, blocks)] if ranked else []
        found[name] = list(dict.fromkeys(marks))
    return found


def _literal(df: DataFrame, order: Sequence[str], row: tuple) -> Column:
    return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, row, strict=True)])


def block_of(df: DataFrame, order: Sequence[str], marks: Sequence[tuple]) -> Column:
    """Number of the block of a row: how many splitters are not above it."""
    if not marks:
        return F.lit(0)
    bounds = F.array(*[_literal(df, order, row) for row in marks])
    mine = F.struct(*[F.col(c).alias(c) for c in order])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(marks).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= mine, at + step).otherwise(at)
    )


def _before(counts: Mapping[int, int], blocks: int) -> list[int]:
    """Rows in earlier blocks, for every block."""
    out, total = [], 0
    for b in range(blocks):
        out.append(total)
        total += counts.get(b, 0)
    return out


def _entry(values: Sequence[int], block: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col(block))


def order_indexes(df: DataFrame, orders: Mapping[str, Sequence[str]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """1-based places of every row in several ascending orders, nulls first: ``{new column: order}``.

    The rows are written once; one sample and one count serve all orders, and each costs one shuffle
    of blocks. Every order must be total.
    """
    rows = cut_lineage(df)
    marks = splitters(rows, orders, block_rows)
    for i, (name, order) in enumerate(orders.items()):
        rows = rows.withColumn(f"__block_{i}", block_of(df, order, marks[name]))
    entries = F.array(*[F.struct(F.lit(i).alias("order"), F.col(f"__block_{i}").alias("block")) for i in range(len(orders))])
    listed = rows.select(F.explode(entries).alias("e")).groupBy("e.order", "e.block").count().collect()
    for i, name in enumerate(orders):
        counts = {r["block"]: r["count"] for r in listed if r["order"] == i}
        place = Window.partitionBy(f"__block_{i}").orderBy(*orders[name])
        before = _entry(_before(counts, len(marks[name]) + 1), f"__block_{i}")
        rows = rows.withColumn(name, before + F.row_number().over(place))
    return rows.drop(*[f"__block_{i}" for i in range(len(orders))])


def lag_any_length(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    new: Mapping[str, tuple[str, int]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Values of earlier (n > 0) or later (n < 0) rows of a group: ``{name: (column, n)}``.

    As a window over ``keys`` by ``order`` would give, but a group may have any length, and without keys the
    whole table is the group. ``order`` is ascending, nulls first, and total within a group. What
    lies across the edge of a block is among at most 2 max|n| rows of each block; these are broadcast.
    """
    whole = [*keys, *order]
    marks = splitters(df, {"all": whole}, block_rows)["all"]
    rows = df.withColumn("__block", block_of(df, whole, marks))
    counts = {r["__block"]: r["count"] for r in rows.groupBy("__block").count().collect()} if marks else {}
    sizes = [counts.get(b, 0) for b in range(len(marks) + 1)]
    place = Window.partitionBy("__block").orderBy(*whole)
    rows = rows.withColumn("__at", F.row_number().over(place).cast("long"))
    group = F.struct(*[F.col(k).alias(k) for k in keys], F.lit(0).alias("__one")).alias("group")
    values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(dict.fromkeys(c for c, _ in new.values()))])
    place_of = {c: i for i, c in enumerate(dict.fromkeys(c for c, _ in new.values()))}
    held = F.struct(group, values.alias("values"))
    distances = sorted({n for _, n in new.values()})
    rows = rows.withColumns({f"__row_{i}": F.lag(held, n).over(place) for i, n in enumerate(distances)})
    if marks:
        reach = max(map(abs, distances))
        rows = rows.withColumn("__whole", _entry(_before(counts, len(sizes)), "__block") + F.col("__at"))
        edge = (F.col("__at") <= reach) | (F.col("__at") > _entry(sizes, "__block") - reach)
        edges = rows.where(edge).select(F.col("__whole").alias("__place"), held.alias("__held"))
        for i, n in enumerate(distances):
            carried = F.broadcast(edges.select((F.col("__place") + n).alias("__whole"), F.col("__held").alias("__carried")))
            rows = rows.join(carried, "__whole", "left").withColumn(f"__row_{i}", F.coalesce(f"__row_{i}", "__carried"))
            rows = rows.drop("__carried")
    for name, (c, n) in new.items():
        found = F.col(f"__row_{distances.index(n)}")
        same = found["group"].eqNullSafe(F.struct(*[F.col(k).alias(k) for k in keys], F.lit(0).alias("__one")))
        rows = rows.withColumn(name, F.when(same, found["values"][f"v{place_of[c]}"]))
    return rows.select(*[c for c in df.columns if c not in new], *new)
