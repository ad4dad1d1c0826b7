"""Reproducible outcome draws.

Draws are spread over the cluster by (key, block). Every draw inverts its distribution at a
uniform number that depends only on the seed, the key, the side and the draw, so the
result does not depend on partitioning, a lost block is redrawn identically, and any SQL
engine draws the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.shares import two_party_margin
from panelcast.operators.quantiles import exact_quantiles
from panelcast.session import cut_lineage


def _spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows spread over the configured shuffle partitions, at least twice the cores now present.

    A number is given because adaptive execution would merge these tiny partitions,
    and their rows are cheap to ship but expensive to expand. The cores alone would not do: with
    dynamic allocation few are there when the plan is made.
    """
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(configured, 2 * spark.sparkContext.defaultParallelism), *columns)


#: Standard deviations and counts around the mean outside which lies less than one step of a uniform number.
_REACH_SD, _REACH = 9, 40


def binomial_tables(probabilities: DataFrame, keys: Sequence[str], size: str, sides: dict[str, str]) -> DataFrame:
    """Per key and side: the lowest count and the cumulative distribution from there on.

    The weight of a count is reached by walking from the most likely one, step by step, with the ratio
    of neighbouring probabilities as a sum of logarithms; dividing by the sum of all weights
    makes them probabilities, so no factorial is needed. A table holds some
    18 standard deviations of counts. Chances outside 0 to 1 count as these; without a size of at
    least 0 or a chance there is no table.
    """
    named = F.array(*[F.struct(F.lit(name).alias("side"), F.col(p).cast("double").alias("p")) for name, p in sides.items()])
    rows = probabilities.select(*keys, F.col(size).cast("long").alias("__n"), F.explode(named).alias("__s"))
    rows = rows.where("__n >= 0 AND __s.p IS NOT NULL AND NOT isnan(__s.p)")
    rows = rows.selectExpr(*[f"`{k}`" for k in keys], "__s.side", "__n", "greatest(0D, least(1D, __s.p)) AS __p")
    certain, edge = "__p <= 0 OR __p >= 1", "CASE WHEN __p >= 1 THEN __n ELSE 0L END"
    reach = f"{_REACH_SD} * sqrt(__n * __p * (1 - __p)) + {_REACH}"
    counts = rows.selectExpr(
        "*",
        f"CASE WHEN {certain} THEN {edge} ELSE greatest(0L, floor(__n * __p - ({reach}))) END AS __lo",
        f"CASE WHEN {certain} THEN {edge} ELSE least(__n, ceil(__n * __p + {reach})) END AS __hi",
    ).selectExpr("*", "explode(sequence(__lo, __hi)) AS __k")
    step = F.expr("CASE WHEN __k = __lo THEN 0D ELSE ln(((__n - __k + 1) * __p) / (__k * (1 - __p))) END")
    whole = Window.partitionBy(*keys, "side")
    upto = whole.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    walked = counts.withColumn("__walked", F.sum(step).over(upto))
    weighed = walked.withColumn("__weight", F.exp(F.col("__walked") - F.max("__walked").over(whole)))
    summed = weighed.withColumn("__summed", F.sum("__weight").over(upto))
    return (
        summed.withColumn("__upto", F.col("__summed") / F.max("__summed").over(whole))
        .groupBy(*keys, "side")
        .agg(F.min("__lo").alias("lo"), F.sort_array(F.collect_list("__upto")).alias("upto"))
    )


def _inverted(table: Column, u: Column) -> Column:
    """The count whose stretch of the cumulative distribution holds ``u``, by halving steps."""
    steps = F.transform(
        F.sequence(F.ceil(F.log2(F.size(table["upto"]) + 1)).cast("int"), F.lit(0), F.lit(-1)),
        lambda b: F.pow(F.lit(2), b).cast("int"),
    )
    below = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(table["upto"], at + step - 1) <= u, at + step).otherwise(at),
    )
    return F.when(table.isNotNull(), table["lo"] + below)


def binomial_draws(
    probabilities: DataFrame,
    keys: Sequence[str],
    size: str,
    sides: dict[str, str],
    n_draws: int,
    seed: int,
    block: int = 1000,
) -> DataFrame:
    """``n_draws`` binomial counts per key and side: ``{output column: probability column}``.

    Each draw is exact: the inverse of the distribution at a keyed uniform number. One output row per key and
    draw, numbered from 1; keys are unique. A key without a size or with a missing probability keeps its
    rows, with NULL counts where nothing can be drawn.
    """
    names = list(sides)
    tables = binomial_tables(probabilities, keys, size, sides)
    wide = tables.groupBy(*keys).agg(
        *[F.max(F.when(F.col("side") == name, F.struct("lo", "upto"))).alias(f"__{name}") for name in names]
    )
    a, b = probabilities.select(*keys).alias("a"), wide.alias("b")
    on = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
    rows = a.join(b, on, "left").select(*[F.col(f"a.{k}").alias(k) for k in keys], *[f"__{name}" for name in names])
    blocks = -(-n_draws // block)
    tasks = _spread(rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), [*keys, "__block"])
    first = F.col("__block") * block + 1

    def drawn(i: Column) -> Column:
        at = [keyed_uniform(seed, *[F.col(k) for k in keys], F.lit(name), i) for name in names]
        counts = [_inverted(F.col(f"__{name}"), u).alias(name) for name, u in zip(names, at, strict=True)]
        return F.struct(i.cast("long").alias("draw"), *counts)

    numbers = F.sequence(first, F.least(first + block - 1, F.lit(n_draws)))
    return tasks.select(*keys, F.explode(F.transform(numbers, drawn)).alias("__drawn")).select(*keys, "__drawn.*")


def margin_summary(
    draws: DataFrame, keys: Sequence[str], d: str, r: str, quantiles: Sequence[float]
) -> DataFrame:
    """Win rate of the first side, median and quantiles of the two-party margin.

    Quantiles narrow counted bins, so no key's draws meet in one task, however many there are. A key
    without any margin keeps its row, with zero draws and NULL statistics.
    """
    margins = cut_lineage(draws.select(*keys, two_party_margin(d, r).alias("margin")))
    out = margins.groupBy(*keys).agg(
        F.count("margin").alias("draws"),
        F.avg((F.col("margin") > 0).cast("double")).alias("win_rate"),
        F.avg("margin").alias("mean_margin"),
    )
    marks = exact_quantiles(margins, keys, "margin", quantiles)
    on = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
    named = [F.col("b.marks")[i].alias(f"q{round(q * 100):02d}") for i, q in enumerate(quantiles)]
    return out.alias("a").join(marks.alias("b"), on, "left").select("a.*", *named)


def keyed_uniform(seed: int, *parts: Column) -> Column:
    """A uniform number in [0, 1) that depends only on the seed and the parts.

    The first 52 bits of an MD5 digest: built-in, and equal in any SQL engine.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return digits / F.lit(float(1 << 52))


def turnout_draws(
    probabilities: DataFrame,
    keys: Sequence[str],
    size: str,
    p_d: str,
    p_r: str,
    scenarios: Sequence[tuple[str, float, float, float, float]],
    n_draws: int,
    seed: int,
    block: int = 1000,
) -> DataFrame:
    """Expected votes per key, scenario and draw with turnout uniform in each side's bounds.

    Scenarios are a short literal list, unrolled on each key row; draws are unrolled
    in blocks that are spread before they are expanded.
    """
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(dl).alias("d_lo"),
                F.lit(dh).alias("d_hi"),
                F.lit(rl).alias("r_lo"),
                F.lit(rh).alias("r_hi"),
            )
            for name, dl, dh, rl, rh in scenarios
        ]
    )
    blocks = -(-n_draws // block)
    spread = _spread(
        probabilities.select(*keys, size, p_d, p_r)
        .withColumn("s", F.explode(listed))
        .select(*keys, size, p_d, p_r, "s.*")
        .withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))),
        [*keys, "scenario", "__block"],
    )
    first = f"__block * {block} + 1"
    rows = spread.withColumn(
        "draw", F.expr(f"explode(sequence({first}, least({first} + {block - 1}, {n_draws})))")
    )

    def turnout(side: str) -> Column:
        u = keyed_uniform(seed, *[F.col(k) for k in keys], F.col("scenario"), F.lit(side), F.col("draw"))
        return F.col(f"{side}_lo") + u * (F.col(f"{side}_hi") - F.col(f"{side}_lo"))

    return rows.withColumns(
        {
            "d_votes": F.col(size) * F.col(p_d) * turnout("d"),
            "r_votes": F.col(size) * F.col(p_r) * turnout("r"),
        }
    ).select(*keys, "scenario", "draw", "d_votes", "r_votes")
