"""Binomial logit per key, all keys at once.

Each Newton step is one aggregate over the design table. Rows with equal
predictors are merged first (a binomial likelihood only needs their summed
successes and trials) and the merged design is written to the shared checkpoint
folder. Up to a counted number of keys, the per-key state is broadcast: the design
is read in place, wherever its rows are, and only partial sums are shuffled.
Beyond that, the design is written once in the partitioning of the steps: by key, and where keys
were counted to hold more than an even share of the rows, by a salt taken from the predictors as
well. A step then moves the state, one row a key and salt, and never the design. State is
written once per round of steps, which keeps the plan short and lets a lost executor
replay a few steps at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.moments import quoted
from panelcast.operators.ols import sweep
from panelcast.session import cut_lineage, cut_lineage_in_place

MAX_STEPS = 25
# keys whose state (a few numbers each) may be broadcast
BROADCAST_KEYS = 50_000
# steps chained between two checkpoints; a key that has settled stays where it is
STEPS_PER_ROUND = 2
DEVIANCE_TOLERANCE = 1e-8


def logistic(eta: str) -> str:
    """Inverse of the logit link."""
    return f"(1D / (1D + exp(-({eta}))))"


def _log_logistic(eta: str) -> str:
    """log(1 / (1 + exp(-eta))) without overflow."""
    return f"(least({eta}, 0D) - log1p(exp(-abs({eta}))))"


def _x_log_x(part: str, whole: str) -> str:
    return f"CASE WHEN {part} > 0 THEN {part} * ln({part} / {whole}) ELSE 0D END"


def binomial_design(
    df: DataFrame, keys: Sequence[str], successes: str, trials: str, xs: Sequence[str]
) -> DataFrame:
    """Complete rows, merged where key and predictors coincide."""
    complete = " AND ".join(f"`{c}` IS NOT NULL" for c in (successes, trials, *xs))
    rows = df.filter(f"{complete} AND `{trials}` > 0").selectExpr(
        *quoted(keys),
        *[f"CAST(`{x}` AS DOUBLE) AS x_{i}" for i, x in enumerate(xs)],
        f"CAST(`{successes}` AS DOUBLE) AS s",
        f"CAST(`{trials}` AS DOUBLE) AS n",
    )
    predictors = [f"x_{i}" for i in range(len(xs))]
    # the saturated likelihood belongs to the rows as they came, not to the merged ones
    saturated = F.expr(f"sum({_x_log_x('s', 'n')} + {_x_log_x('(n - s)', 'n')}) AS saturated")
    return rows.groupBy(*keys, *predictors).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), saturated)


def heavy_keys(design: DataFrame, keys: Sequence[str], share: int) -> DataFrame:
    """Keys with more than a ``share``-th of the rows, and into how many parts each is split.

    There are fewer than ``share`` of them, whatever the data.
    """
    rows = cut_lineage(design.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")))
    even = -(-(rows.agg(F.sum("rows")).first()[0] or 0) // share)
    parts = F.ceil(F.col("rows") / F.lit(max(even, 1))).cast("int")
    return cut_lineage(rows.filter(F.col("rows") > even).select(*keys, parts.alias("salts")))


def spread_design(design: DataFrame, heavy: DataFrame, keys: Sequence[str], k: int, parts: int) -> DataFrame:
    """The design written in the partitioning and order of the steps."""
    predictors = ", ".join(f"x_{i}" for i in range(k))
    salted = design.join(F.broadcast(heavy), list(keys), "left").selectExpr(
        *[f"`{c}`" for c in design.columns], f"CAST(pmod(xxhash64({predictors or '0'}), coalesce(salts, 1)) AS INT) AS salt"
    )
    return cut_lineage_in_place(salted.repartition(parts, *keys, "salt").sortWithinPartitions(*keys, "salt"))


def copied_state(state: DataFrame, heavy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of state for each part of a key."""
    joined = state.join(F.broadcast(heavy), list(keys), "left")
    return joined.withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).drop("salts")


def _start(design: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Pooled log odds as intercept, zero slopes, predictors centred at their weighted means."""
    columns = [
        *[f"sum(x_{i} * n) / sum(n) AS c_{i}" for i in range(k)],
        "ln((sum(s) + 0.5D) / (sum(n) - sum(s) + 0.5D)) AS beta_0",
        *[f"0D AS beta_{i + 1}" for i in range(k)],
        "sum(saturated) AS saturated",
        "CAST(NULL AS DOUBLE) AS deviance",
        "0 AS steps",
        "false AS converged",
        *[f"true AS kept_{i}" for i in range(k + 1)],
    ]
    return design.groupBy(*keys).agg(*map(F.expr, columns))


def _step(
    design: DataFrame,
    state: DataFrame,
    keys: Sequence[str],
    k: int,
    tolerance: float,
    heavy: DataFrame | None,
) -> DataFrame:
    """Deviance at the current coefficients, then one Newton step.

    Without ``heavy`` the state is broadcast; with it the design lies by key and salt.
    """
    p = k + 1
    z = ["1D", *[f"(x_{i} - c_{i})" for i in range(k)]]
    eta = " + ".join(f"beta_{i} * {z[i]}" for i in range(p))
    by = list(keys) if heavy is None else [*keys, "salt"]
    other = F.broadcast(state) if heavy is None else copied_state(state, heavy, keys)
    joined = design.drop("saturated").join(other, by)
    rows = (
        joined
        .selectExpr("*", f"{eta} AS eta")
        .selectExpr("*", f"{logistic('eta')} AS mu")
        .selectExpr("*", "s - n * mu AS score", "n * mu * (1D - mu) AS weight")
    )
    carried = [
        *[f"c_{i}" for i in range(k)],
        *[f"beta_{i}" for i in range(p)],
        "saturated",
        "deviance",
        "steps",
    ]
    summed = {
        "likelihood": f"s * {_log_logistic('eta')} + (n - s) * {_log_logistic('-eta')}",
        **{f"g_{i}": f"score * {z[i]}" for i in range(p)},
        **{f"h_{i}_{j}": f"weight * {z[i]} * {z[j]}" for i in range(p) for j in range(i, p)},
    }
    constant = [F.expr(f"any_value({c}) AS {c}") for c in carried]
    totals = rows.groupBy(*by).agg(
        *constant, *[F.expr(f"sum({e}) AS {name}") for name, e in summed.items()]
    )
    if heavy is not None:
        totals = totals.groupBy(*keys).agg(
            *constant, *[F.expr(f"sum({name}) AS {name}") for name in summed]
        )
    entries = {(i, j): f"h_{i}_{j}" for i in range(p) for j in range(i, p)}
    entries |= {(i, p): f"g_{i}" for i in range(p)} | {(p, p): "0D"}
    solved = sweep(
        totals,
        "q",
        p + 1,
        entries,
        [f"h_{i}_{i} * 1e-11D" for i in range(p)],
    ).selectExpr("*", "2D * (saturated - likelihood) AS now")
    settled = f"coalesce(abs(now - deviance) / (abs(now) + 0.1D) < {tolerance!r}D, false)"
    moved = [
        f"CASE WHEN q_inv_{i} IS NULL THEN beta_{i} ELSE beta_{i} + q_a_{i}_{p} END AS beta_{i}"
        for i in range(p)
    ]
    return solved.selectExpr("*", f"{settled} AS settled").selectExpr(
        *quoted(keys),
        *[f"c_{i}" for i in range(k)],
        *moved,
        "saturated",
        "now AS deviance",
        "CASE WHEN settled THEN steps ELSE steps + 1 END AS steps",
        "settled AS converged",
        *[f"q_inv_{i} IS NOT NULL AS kept_{i}" for i in range(p)],
    )


def _at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def logit_by_key(
    df: DataFrame,
    keys: Sequence[str],
    successes: str,
    trials: str,
    xs: Sequence[str],
    max_steps: int = MAX_STEPS,
    tolerance: float = DEVIANCE_TOLERANCE,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Binomial logit of (successes, trials - successes) on ``xs`` for every key.

    Returns ``b0``, ``b_i`` (NULL when the key cannot identify it), ``deviance``,
    ``steps`` and ``converged``. Stops when the relative change of the deviance
    falls under ``tolerance`` for all keys, or after ``max_steps``; the step of that last look is
    still taken, so settled coefficients are exact to the last digits.
    """
    k = len(xs)
    design = cut_lineage(binomial_design(df, keys, successes, trials, xs))
    few = _at_most(design, broadcast_keys) or _at_most(design.select(*keys).distinct(), broadcast_keys)
    state = _start(design, keys, k)
    heavy = None
    if not few:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        heavy = heavy_keys(design, keys, parts)
        design = spread_design(design, heavy, keys, k, parts)
    finished = []
    # one more round than steps: the last one only measures the final deviance
    for done in range(0, max_steps + 1, STEPS_PER_ROUND):
        for _ in range(min(STEPS_PER_ROUND, max_steps + 1 - done)):
            state = _step(design, state, keys, k, tolerance, heavy)
        state = cut_lineage(state)
        finished.append(state.filter("converged"))
        state = state.filter("NOT converged")
        if state.isEmpty():
            break
    out = reduce(DataFrame.unionByName, finished, state)
    slope = [f"CASE WHEN kept_{i + 1} THEN beta_{i + 1} END" for i in range(k)]
    shift = "".join(f" - coalesce({slope[i]}, 0D) * c_{i}" for i in range(k))
    return out.selectExpr(
        *quoted(keys),
        f"beta_0{shift} AS b0",
        *[f"{b} AS b_{i}" for i, b in enumerate(slope)],
        "deviance",
        "steps",
        "converged",
    )


def response(xs: Sequence[str], prefix: str = "b") -> str:
    """SQL for the fitted probability at new predictor values."""
    parts = "".join(f" + coalesce({prefix}_{i}, 0D) * `{x}`" for i, x in enumerate(xs))
    return logistic(f"{prefix}0{parts}")
