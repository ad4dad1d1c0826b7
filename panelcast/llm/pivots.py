"""Near-equal vectors by a pivot-permutation index."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.components import components
from panelcast.llm.shared import by_group, sorted_groups, table, written

#: Nearest reference points that describe a vector, in order.
PREFIX = 8
#: Most reference points; their vectors are what is sent to executors.
PIVOTS = 4096
#: Cosine that no two reference points exceed, so that a dense group hangs on one point.
APART = 0.8
#: Vectors of a label up to which all are compared with each other.
WHOLE = 1024
#: Vectors of an inverted list that one task compares with each other.
BLOCK = 1024
LEAST_COSINE = 0.98


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None where it has no direction."""
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return None
    v = np.asarray(vector, dtype=np.float64) + 0.0
    return v if np.isfinite(v).all() and v.any() else None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        keys, vectors = [], []
        for vector, label in zip(rows["embedding"], rows["label"], strict=True):
            v = usable(vector) if label is not None else None
            keys.append(None if v is None else hashlib.blake2b(str(label).encode() + b" " + v.tobytes(), digest_size=16).digest())
            vectors.append(None if v is None else v)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows["vec_id"], pa.int64()),
                pa.array([None if x is None else str(x) for x in rows["label"]], pa.string()),
                pa.array(keys, pa.binary()),
                pa.array(vectors, pa.list_(pa.float64())),
            ],
            ["vec_id", "label", "key", "vector"],
        )


def _thinned(vectors: list, apart: float) -> np.ndarray:
    """Unit vectors of which no two have a cosine above ``apart``, those standing for most others first."""
    unit = np.array(vectors, dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    kept, stands, left = [], [], np.arange(len(unit))
    while len(left):
        near = unit[left] @ unit[left[0]] > apart
        near[0] = True
        kept.append(left[0])
        stands.append(np.count_nonzero(near))
        left = left[~near]
    return unit[np.array(kept)[np.argsort(-np.array(stands), kind="stable")]]


def _describe(pivots: dict[int, np.ndarray], prefix: int, large: set[tuple[str, int]]):
    """One row for each reference point in a vector's prefix; the prefix travels along.

    Vectors of a label outside ``large`` are all in one list.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            out: list[tuple] = []
            for label, rep, n, vector in zip(rows["label"], rows["rep"], rows["n"], rows["vector"], strict=True):
                v = np.asarray(vector)
                unit = v / np.linalg.norm(v)
                points = pivots.get(len(v)) if (label, len(v)) in large else None
                nearest = [-1] if points is None else np.argsort(-(points @ unit), kind="stable")[:prefix].tolist()
                out += [(label, len(v), p, min(nearest), rep, n, vector, nearest) for p in nearest]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32())]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                ["label", "size", "pivot", "earliest", "rep", "n", "vector", "prefix"],
            )

    return describe


def _local_components(near: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each place the first place it is connected to; every place is expanded once."""
    roots, seen = np.arange(len(near)), np.zeros(len(near), bool)
    for start in linked:
        if seen[start]:
            continue
        seen[start] = True
        stack = [start]
        while stack:
            new = np.flatnonzero(near[stack.pop()] & ~seen)
            seen[new], roots[new] = True, start
            stack.extend(new)
    return roots


def _compare(least: float):
    """Links inside one block, or between two; each pair counts in its first shared list only."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, pivot, low, high), rows in sorted_groups(batches, 5):
            reps, times, vectors, prefixes, own = (list(c) for c in zip(*rows, strict=True))
            if len(rows) < 2:
                continue
            v = np.array(vectors)
            unit = v / np.linalg.norm(v, axis=1)[:, None]
            points, at = np.unique(np.concatenate(prefixes), return_inverse=True)
            holds = np.zeros((len(rows), len(points)), np.float32)
            holds[np.repeat(np.arange(len(rows)), [len(p) for p in prefixes]), at] = 1
            earlier = holds[:, points < pivot]
            near = unit @ unit.T >= least
            near &= earlier @ earlier.T == 0
            if low != high:
                own = np.array(own)
                near &= own[:, None] != own[None, :]
            np.fill_diagonal(near, False)
            linked = np.flatnonzero(near.any(axis=1))
            if not len(linked):
                continue
            roots = _local_components(near, linked)
            links = near.astype(np.int64) @ np.array(times, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([reps[i] for i in linked], pa.int64()),
                    pa.array([reps[roots[i]] for i in linked], pa.int64()),
                    pa.array(links[linked]),
                ],
                ["a", "b", "links"],
            )

    return compare


def near_vectors(
    vectors: DataFrame,
    least: float = LEAST_COSINE,
    prefix: int = PREFIX,
    most_pivots: int = PIVOTS,
    block: int = BLOCK,
    whole: int = WHOLE,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector.

    Vectors of a label with equal components are one class, so copies are never compared. Labels
    of up to ``whole`` classes are compared completely. In larger ones each class is described by its
    ``prefix`` nearest reference points; it is listed under each of them, and all
    classes of a list are verified by their cosine. Reference points are thinned from the classes
    with the smallest key digests, a sample that grows with the square root of the classes, up
    to ``most_pivots``: no two are closer than a cosine of ``APART``, so members of a dense group
    hang on the same points. Lists longer than ``block`` are compared in pairs of blocks, so
    none is skipped and no pair is written: a group returns each member's number of
    links and its local component. Classes of a long list that were all compared in one and the same
    earlier list are not compared with each other again.

    Vectors that are null, empty, zero, or hold nulls or non-finite numbers, and those
    without a label, link with nothing. Repeated rows count as vectors of their own; vectors
    of different length never link; a null id is its own component.
    """
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    rows = written(rows.mapInArrow(_keys, "vec_id long, label string, key binary, vector array<double>"), "vectors")
    classes = written(
        rows.where("key IS NOT NULL AND vec_id IS NOT NULL")
        .groupBy("key", "label")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector")),
        "vector-classes",
    )
    n = classes.count()
    wanted = min(most_pivots, max(16, math.ceil(4 * math.sqrt(n))))
    sample = classes.orderBy("key").limit(wanted).select("vector").collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["vector"]), []).append(r["vector"])
    pivots = {size: _thinned(v, APART) for size, v in by_size.items()}
    # At most one row for each ``whole`` classes.
    counts = classes.groupBy("label", F.size("vector").alias("size")).agg(F.count("*").alias("m")).where(F.col("m") > whole)
    large = {(r["label"], r["size"]) for r in counts.collect()}
    listed = written(
        classes.select("label", "rep", "n", "vector").mapInArrow(
            _describe(pivots, prefix, large),
            "label string, size int, pivot int, earliest int, rep long, n long, vector array<double>, prefix array<int>",
        ),
        "pivot-lists",
    )
    lists = ["label", "size", "pivot"]
    sublists = listed.groupBy(*lists, "earliest").agg(F.count("*").alias("m"))
    # Members of the largest sublist that share an earlier point have met there: their blocks skip each other.
    blocks = (
        sublists.groupBy(*lists)
        .agg(F.sum("m").alias("m"), F.max(F.struct("m", "earliest")).alias("most"))
        .withColumn("met", F.when((F.col("m") > block) & (F.col("most.earliest") < F.col("pivot")), F.col("most.earliest")))
        .withColumn("met_m", F.when(F.col("met").isNotNull(), F.col("most.m")).otherwise(0))
        .withColumn("loose", F.ceil((F.col("m") - F.col("met_m")) / block).cast("int"))
        .withColumn("blocks", F.col("loose") + F.ceil(F.col("met_m") / block).cast("int"))
        .select(*lists, "met", "loose", "blocks")
    )
    is_met = F.coalesce(F.col("earliest") == F.col("met"), F.lit(False))
    place = lambda low, n: low + F.pmod(F.xxhash64("rep"), n).cast("int")
    others = F.when(is_met, F.col("loose")).otherwise(F.col("blocks"))
    placed = (
        listed.join(blocks, lists)
        .withColumn("own", F.when(is_met, place(F.col("loose"), F.col("blocks") - F.col("loose"))).otherwise(place(F.lit(0), F.col("loose"))))
        .withColumn("others", others)
        .where("others > 0")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .select(
            *lists, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "rep", "n", "vector", "prefix", "own"
        )
    )
    found = written(
        by_group(placed, *lists, "low", "high").mapInArrow(_compare(least), "a long, b long, links long"), "vector-links"
    )
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b"))
    settled = (
        classes.select("key", "rep", "n")
        .join(links, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = F.col("component_id").isNull()
    return rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(settled, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (alone | (F.col("vec_id") == F.col("component_id"))).alias("kept"),
    )


def op7_pivot_permutation(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector of ``embeddings`` at a cosine of 0.98."""
    return near_vectors(table(spark, folder, "embeddings"))
