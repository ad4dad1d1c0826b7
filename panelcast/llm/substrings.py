"""Repeated windows of words, counted exactly in buckets of their minimisers.

Consecutive windows with one minimiser overlap in all but a word, so they travel as one
packed string of words instead of one row each. Only minimisers that occur in two documents can hold
a repeated window; the others are settled from a table of hashes before any text moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.shared import WordHashes, mixed, table, written

WINDOW = 50
#: Words hashed together when a window looks for its minimiser.
SEED = 20
#: A minimiser that occurs more often is counted window by window, which spreads it.
BUCKET = 200
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not known or len(known[0]) < n:
        size = max(n, 1 << 14)
        base = np.full(size, _ODD)
        base[0] = 1
        inverse = np.full(size, np.uint64(pow(int(_ODD), -1, 1 << 64)))
        inverse[0] = 1
        known[:] = [np.multiply.accumulate(base), np.multiply.accumulate(inverse)]
    return known[0][:n], known[1][:n]


class Minimisers:
    """Super-k-mers of a text: (first window, number of windows, minimiser)."""

    def __init__(self, window: int = WINDOW, seed: int = SEED):
        self.window, self.seed = window, min(seed, window)
        self.hashes = WordHashes()
        self.known: list[np.ndarray] = []

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Empty for fewer words than a window."""
        n = len(words)
        if n < self.window:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        up, down = _powers(n + 1, self.known)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes.of(words) * up[:n], out=sums[1:])
        seeds = mixed((sums[self.seed :] - sums[: n + 1 - self.seed]) * down[: n + 1 - self.seed])
        at = np.lib.stride_tricks.sliding_window_view(seeds, self.window - self.seed + 1).argmin(axis=1)
        at += np.arange(len(at))
        firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return firsts, np.diff(np.concatenate([firsts, [len(at)]])), seeds[at[firsts]]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _minimisers(window: int, seed: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Minimisers(window, seed)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = [np.unique(finder.of(_words(t.as_py()))[2], return_counts=True) for t in batch.column("text")]
            values = np.concatenate([*(p for p, _ in parts), np.empty(0, np.uint64)]).view(np.int64)
            times = np.concatenate([*(c for _, c in parts), np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(p) for p, _ in parts]), pa.int64()), pa.array(values), pa.array(times)],
                ["doc_id", "minimiser", "times"],
            )

    return found


def _packed(window: int, seed: int):
    """Super-k-mers of the shared minimisers of each document; hot ones as single windows."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Minimisers(window, seed)
        names = ["doc_id", "start", "minimiser", "packed", "digest"]
        for batch in batches:
            rows = []
            for doc_id, text, cold, hot in batch[["doc_id", "text", "cold", "hot"]].itertuples(index=False):
                words = _words(text)
                firsts, counts, seeds = finder.of(words)
                seeds = seeds.view(np.int64)
                for k in np.flatnonzero(np.isin(seeds, cold)):
                    a, n = int(firsts[k]), int(counts[k])
                    rows.append((doc_id, a, int(seeds[k]), b" ".join(words[a : a + n + window - 1]), None))
                for k in np.flatnonzero(np.isin(seeds, hot)):
                    for a in range(int(firsts[k]), int(firsts[k] + counts[k])):
                        one = b" ".join(words[a : a + window])
                        rows.append((doc_id, a, int(seeds[k]), None, hashlib.blake2b(one, digest_size=16).digest()))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return pack


def runs(starts: list[int]) -> list[tuple[int, int]]:
    """Sorted window numbers as (first, number of consecutive ones)."""
    out: list[tuple[int, int]] = []
    for start in starts:
        if out and start == sum(out[-1]):
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((start, 1))
    return out


def count_bucket(rows: list[tuple[int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """Of one bucket's (document, start, packed): runs of windows that an earlier document has.

    Equal strings are settled by their smallest document. The windows of different strings
    are sorted, so that equal ones lie next to each other.
    """
    owner: dict[bytes, int] = {}
    for doc_id, _, packed in rows:
        owner[packed] = min(owner.get(packed, doc_id), doc_id)
    split = {packed: packed.split(b" ") for packed in owner}
    low: dict[tuple[bytes, int], int] = {}
    if len(owner) > 1:
        entries = sorted(
            (words[i : i + window], owner[packed], packed, i)
            for packed, words in split.items()
            for i in range(len(words) - window + 1)
        )
        first = None
        for words, doc_id, packed, i in entries:
            if first is None or words != first[0]:
                first = (words, doc_id)
            low[packed, i] = first[1]
    found = []
    for doc_id, start, packed in rows:
        windows = range(len(split[packed]) - window + 1)
        mine = [start + i for i in windows if low.get((packed, i), owner[packed]) < doc_id]
        found += [(doc_id, a, n) for a, n in runs(mine)]
    return found


def _count_buckets(window: int):
    """Buckets one after another from a partition sorted by minimiser."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rows = None, []
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            columns = (batch[c] for c in ("minimiser", "doc_id", "start", "packed"))
            for minimiser, doc_id, start, packed in zip(*columns, strict=True):
                if minimiser != current and rows:
                    found += count_bucket(rows, window)
                    rows = []
                current = minimiser
                rows.append((doc_id, start, bytes(packed)))
            yield pd.DataFrame(found, columns=["doc_id", "start", "n"])
        if rows:
            yield pd.DataFrame(count_bucket(rows, window), columns=["doc_id", "start", "n"])

    return count


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, start, n``: runs of windows whose words also start in a smaller document.

    1. Minimisers of every document, without text; those of one document only are settled.
    2. Documents with a shared minimiser are read again and their super-k-mers of these
       minimisers go to the minimiser's bucket, at most ``bucket`` of them, to be sorted.
    3. Windows of more frequent minimisers go by their own 128-bit digest, are reduced to
       the smallest document before the shuffle, and join back.

    Rows with a null id are left out here, fewer words than a window give no windows, and rows
    that repeat an id count as one document.
    """
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    pairs = written(texts.mapInArrow(_minimisers(window, seed), "doc_id long, minimiser long, times long"), "minimisers")
    shared = (
        pairs.groupBy("minimiser")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("times").alias("n"))
        .where("low < high")
        .select("minimiser", (F.col("n") > bucket).alias("is_hot"))
    )
    mine = F.col("minimiser")
    wanted = (
        pairs.join(shared, "minimiser")
        .groupBy("doc_id")
        .agg(
            F.collect_set(F.when(~F.col("is_hot"), mine)).alias("cold"),
            F.collect_set(F.when(F.col("is_hot"), mine)).alias("hot"),
        )
    )
    rows = texts.join(wanted, "doc_id").mapInPandas(
        _packed(window, seed), "doc_id long, start int, minimiser long, packed binary, digest binary"
    )
    rows = written(rows, "super-k-mers")
    cold = (
        rows.where("packed IS NOT NULL")
        .repartition("minimiser")
        .sortWithinPartitions("minimiser")
        .mapInPandas(_count_buckets(window), "doc_id long, start int, n int")
    )
    spread = rows.where("digest IS NOT NULL").select("doc_id", "start", "digest")
    first = spread.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    hot = spread.join(first.select("digest", "low"), "digest").where("doc_id > low")
    return cold.unionByName(hot.select("doc_id", "start", F.lit(1).alias("n")))


def covered(starts: np.ndarray, ends: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie in any of the ranges."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _kept(window: int):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                words = _words(text)
                kept = words
                if spans is not None and len(spans):
                    starts, ends = np.array([(s["start"], s["start"] + s["n"] - 1 + window) for s in spans]).T
                    gone = covered(starts, ends, len(words))
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])

    return keep


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: texts without words of windows seen in smaller documents.

    Kept words are joined by one space. Null texts have no words; documents shorter than a
    window lose nothing; rows with a null id stay whole; repeated rows of an id
    are treated alike; other columns are ignored; an empty table gives no rows.
    """
    found = repeated_windows(docs, window, seed, bucket)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    return joined.mapInPandas(_kept(window), "doc_id long, n_words long, n_removed long, kept string")


def op4_superkmer_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its words, those removed, and a checksum of the rest."""
    rows = remove_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
