"""Panel verbs on (unit, period) tables: lags, changes, slices, reshaping, order.

Windows run only over tables that are already aggregated to one row per unit and
period, so a window partition is as long as the list of periods.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.shares import challenger_party, incumbent_party, side_value
from panelcast.session import cut_lineage, small_side


def _window(units: Sequence[str], period: str):
    return Window.partitionBy(*units).orderBy(period)


def lag_columns(
    df: DataFrame, units: Sequence[str], period: str, new: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """Values of earlier (n > 0) or later (n < 0) rows of the unit: ``{name: (column, n)}``.

    Counts rows, not calendar periods: a missing period shifts the lag.
    """
    w = _window(units, period)
    return df.withColumns({name: F.lag(c, n).over(w) for name, (c, n) in new.items()})


def change_columns(
    df: DataFrame, units: Sequence[str], period: str, new: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """Difference to the value ``n`` rows back, for many columns over one window."""
    w = _window(units, period)
    return df.withColumns({name: F.col(c) - F.lag(c, n).over(w) for name, (c, n) in new.items()})


def calendar_lag(
    df: DataFrame, units: Sequence[str], period: str, step: int, new: Mapping[str, str]
) -> DataFrame:
    """Value exactly ``step`` periods earlier, NULL when that period is missing."""
    earlier = df.select(
        *units,
        (F.col(period) + step).alias(period),
        *[F.col(c).alias(name) for name, c in new.items()],
    )
    return df.join(earlier, [*units, period], "left")


def period_columns(
    df: DataFrame, units: Sequence[str], period: str, value: str, periods: Mapping[int, str]
) -> DataFrame:
    """Long to wide for chosen periods: one row per unit, one column per period."""
    return (
        df.filter(F.col(period).isin(list(periods)))
        .groupBy(*units)
        .agg(*[F.max(F.when(F.col(period) == p, F.col(value))).alias(name) for p, name in periods.items()])
    )


def wide_to_long(
    df: DataFrame,
    units: Sequence[str],
    columns: Mapping[str, int],
    period: str,
    value: str,
) -> DataFrame:
    """One column per period back to rows, labelled by what the column stands for."""
    entries = F.array(
        *[
            F.struct(F.lit(p).alias(period), F.col(f"`{c}`").alias(value))
            for c, p in columns.items()
        ]
    )
    return df.select(*units, F.explode(entries).alias("entry")).select(
        *units, f"entry.{period}", f"entry.{value}"
    )


def every_kth(df: DataFrame, period: str, k: int, offset: int = 0) -> DataFrame:
    """Every k-th period of a regular series, told by the period itself."""
    return df.filter(F.pmod(F.col(period) - F.lit(offset), F.lit(k)) == 0)


def first_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """The first row of every key by an explicit order, as an aggregate.

    ``min_by`` combines on the map side, so a key with a third of the rows is not
    sorted in one task the way a row-number window would.
    """
    rank = F.struct(*order)
    best = F.min_by(F.struct(*columns), rank)
    return df.groupBy(*keys).agg(best.alias("first")).select(*keys, *[f"first.{c}" for c in columns])


def order_index(df: DataFrame, order: Sequence[Column | str], name: str = "order_index") -> DataFrame:
    """1-based position of each row in the whole table's order, without one big window.

    A range-partitioned sort is written out, after which partition number and
    position are fixed; only one count per partition is added up centrally.
    ``order`` must be total.
    """
    ordered = cut_lineage(df.orderBy(*order))
    placed = ordered.withColumns(
        {
            "__part": F.spark_partition_id(),
            "__pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset")
    )
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__offset") + F.col("__pos") + 1)
        .drop("__part", "__pos", "__offset")
    )


def strongest(df: DataFrame, by: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k largest and the k smallest rows, labelled by end."""
    top = df.orderBy(F.desc_nulls_last(by), *tie).limit(k).withColumn("end", F.lit("top"))
    bottom = df.orderBy(F.asc_nulls_last(by), *tie).limit(k).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column both sides share."""
    shared = [c for c in left.columns if c in set(right.columns)]
    if not shared:
        raise ValueError("no shared columns to join on")
    return left.join(right, shared, how)


def members(df: DataFrame, dimension: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Every row labelled by whether its key is in the dimension, in one pass."""
    listed = dimension.select(*keys).distinct().withColumn("__listed", F.lit(True))
    flag = F.when(F.col("__listed"), "member").otherwise("other")
    return df.join(listed, list(keys), "left").withColumn(label, flag).drop("__listed")


def assemble_features(
    polls: DataFrame,
    economy: DataFrame,
    returns: DataFrame,
    in_office: DataFrame,
    demographics: DataFrame,
) -> DataFrame:
    """The feature table from separate inputs, one row per unit, period and side.

    polls(unit, year, party, avg_poll) LEFT JOIN economy(unit, year, ...)
    FULL JOIN returns(unit, year, party, pv, pv2p, lag_pv2p, d_pv2p, r_pv2p)
    LEFT JOIN in_office(year, in_office) LEFT JOIN demographics(unit, year, ...).
    A missing poll is filled from the side's own share.
    """
    joined = (
        polls.join(economy, ["unit", "year"], "left")
        .join(returns, ["unit", "year", "party"], "full")
        .join(small_side(in_office), "year", "left")
        .join(demographics, ["unit", "year"], "left")
    )
    flag = F.col("in_office") == F.col("party")
    return (
        joined.withColumn("is_incumbent", flag)
        .withColumns(
            {
                "inc_party": incumbent_party("party", "is_incumbent"),
                "chl_party": challenger_party("party", "is_incumbent"),
            }
        )
        .withColumns(
            {
                "inc_pv": side_value("inc_party", "d_pv2p", "r_pv2p"),
                "chl_pv": side_value("chl_party", "d_pv2p", "r_pv2p"),
                "avg_poll": F.coalesce("avg_poll", "pv"),
            }
        )
    )
