"""Connected components of an edge table, by joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shared import written
from panelcast.operators.skew import split_join

#: Nodes with their smallest neighbour that are sent to all tasks: 16 bytes each.
NODES = 1_000_000
#: Edges that one task writes, at least: small tables stay in few files, whatever the number of partitions.
ROWS = 50_000


class LocalSets:
    """Union-find over 0..n-1 within one small group; the smallest member is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up


def _few(df: DataFrame, n: int) -> DataFrame:
    """``df``, just shuffled and of about ``n`` rows, in as many partitions as these are worth."""
    return df.coalesce(-(-n // ROWS) or 1)


def _settled(pairs: DataFrame, n: int) -> bool:
    """Whether every larger end has one smaller end that is no larger end itself: stars only."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return _few(nodes, n).agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] == 0


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``rows`` with the smallest neighbour ``m`` of their ``u``. A node in the centre of a large star
    holds most rows, so nodes are sent to the rows up to a counted number, and beyond it heavy nodes are split."""
    side = written(_few(least, n), "least-neighbours")
    return rows.join(F.broadcast(side), "u") if side.count() <= NODES else split_join(rows, side, ["u"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates two steps until only stars are left: every larger neighbour of a node is hung on
    the node's smallest neighbour, then every node's smaller neighbours are. Both
    keep the components and shorten paths, so the rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder. Loops and repeated edges
    do no harm; edges with a null end are ignored; no edges give no rows.
    """
    directed = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = written(directed.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n = pairs.count()
    while not _settled(pairs, n):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(_few(large.where("u <> v").distinct(), n), "edges")
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _with_least(pairs, least, n)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.withColumnRenamed("m", "v"))
        )
        pairs = written(_few(small.where("u <> v").distinct(), n), "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
