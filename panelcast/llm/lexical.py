"""Ranked search without an index: one automaton of all item terms scans the texts.

Terms are framed by blanks, so that an occurrence is a whole term. A first scan counts documents,
terms and in how many documents each item term stands; a second scan scores every document with these
weights and keeps each item's best rows of its partition. Texts never move and no
postings are written; what is shuffled is one row a term or a few rows an item from each partition.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.shared import table, written

#: Bytes of terms that one automaton may hold: what is broadcast never outgrows it, but for one item that does.
BLOCK_BYTES = 4 << 20
#: How many rows an item gets, and the saturation and length weights of its scores.
TOP, K1_PER_MILLE, B_PER_CENT = 10, 800, 75
#: Documents scored between two looks at the best rows; rows that go to Python at once.
_AT_ONCE, _BATCH = 256, 1000
#: Groups of partitions whose best rows meet before those of an item do.
_GROUPS = 64
_SCALE = 1_000_000_000
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z; digits, a-z and all bytes of other characters kept; the rest blank.
_FOLD = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
_BLANK = bytes(b for b in range(128) if not chr(b).isalnum())
_FRAMED = _FOLD.translate(bytes.maketrans(_BLANK, b" " * len(_BLANK)))


def terms_of(text: Column) -> Column:
    """Terms in order, repeats included; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(lower, F.lit(_TERM), F.lit(0))


class TermCounter:
    """Counts of the item terms in a text, by an automaton of the terms between blanks."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.machine.add_word(f" {term} ", i)
        if terms:
            self.machine.make_automaton()

    def of(self, text: str | None) -> tuple[int, Counter]:
        """Number of all terms, and occurrences of each item term by its number."""
        words = (text or "").encode().translate(_FRAMED).split()
        if not words or not len(self.machine):
            return len(words), Counter()
        line = f" {b' '.join(words).decode()} "
        return len(words), Counter(map(itemgetter(1), self.machine.iter(line)))


_BUILT: dict[str, tuple[TermCounter, dict]] = {}


def _built(key: str, sent: Broadcast) -> tuple[TermCounter, dict]:
    """Automaton and contents of a broadcast, built once in each worker process; the last is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (TermCounter(sent.value["terms"]), sent.value)
    return _BUILT[key]


def _count(key: str, sent: Broadcast):
    """Rows (term, documents, terms) of a partition; term -1 stands for all terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = _built(key, sent)
        holding = np.zeros(len(held["terms"]), np.int64)
        docs = total = 0
        for batch in batches:
            for text in batch.column("text"):
                n, found = counter.of(text.as_py())
                docs, total = docs + (n > 0), total + n
                if found:
                    holding[list(found)] += 1
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(holding[at], docs)), pa.array(np.append(0 * at, total))],
            ["term", "docs", "terms"],
        )

    return count


class Best:
    """The k best rows of every item so far: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64) for _ in range(3)]
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, item: np.ndarray, score: np.ndarray, doc: int) -> None:
        """Scores below an item's k-th best are passed over; equal ones wait until ids decide."""
        take = score >= self.least[item]
        if take.any():
            self.new.append((item[take], score[take], np.full(take.sum(), doc)))

    def settle(self) -> None:
        parts = [np.concatenate(x) for x in zip(self.rows, *self.new, strict=True)]
        item, score, doc = parts
        order = np.lexsort((doc, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        last = order[place == self.k - 1]
        self.least[item[last]] = score[last]
        self.rows = [x[order[place < self.k]] for x in parts]
        self.new = []


def document_scores(found: Counter, n: int, held: dict) -> tuple[np.ndarray, np.ndarray]:
    """Items that hold a term of the document, and their scores."""
    terms = np.fromiter(found.keys(), np.int64, len(found))
    times = np.fromiter(found.values(), np.int64, len(found))
    length = 100 - held["b"] + held["b"] * n * held["docs"] // held["total"]
    parts = held["weights"][terms] * (_SCALE * times // (1000 * times + held["k1"] * length // 100))
    starts = held["starts"][terms]
    sizes = held["starts"][terms + 1] - starts
    at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    scores = np.zeros(held["n_items"], np.int64)
    np.add.at(scores, held["items"][at], held["times"][at] * np.repeat(parts, sizes))
    some = np.flatnonzero(scores)
    return some, scores[some]


#: Stands for a null id, behind all others.
_NO_ID = np.iinfo(np.int64).max


def _score(key: str, sent: Broadcast):
    """Rows (item, score, doc_id): each item's best documents of a partition."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = _built(key, sent)
        best = Best(held["n_items"], held["k"])
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            for i, text in enumerate(batch.column("text")):
                n, found = counter.of(text.as_py())
                if found:
                    best.add(*document_scores(found, n, held), ids[i])
                if i % _AT_ONCE == 0 and best.new:
                    best.settle()
        best.settle()
        item, points, doc = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(points), pa.array(doc, mask=doc == _NO_ID)], ["item", "score", "doc_id"]
        )

    return score


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _postings(rows: list[tuple[int, str, int]]) -> dict:
    """Terms, and for each the items that hold it: ``items[starts[t]:starts[t + 1]]``."""
    terms = sorted({term for _, term, _ in rows})
    number = {term: i for i, term in enumerate(terms)}
    of_row = np.array([number[term] for _, term, _ in rows], np.int64)
    order = np.argsort(of_row, kind="stable")
    return {
        "terms": terms,
        "starts": np.searchsorted(of_row[order], np.arange(len(terms) + 1)),
        "items": np.array([item for item, _, _ in rows], np.int64)[order],
        "times": np.array([times for _, _, times in rows], np.int64)[order],
    }


def _block(docs: DataFrame, rows: DataFrame, k: int, k1: int, b: int) -> DataFrame | None:
    """Best documents of the items of one block: two scans of the texts."""
    spark = docs.sparkSession
    listed = [tuple(r) for r in rows.select("item_id", "term", "times").toLocalIterator()]
    ids = list(dict.fromkeys(item for item, _, _ in listed))
    place = {item: i for i, item in enumerate(ids)}
    held = _postings([(place[item], term, times) for item, term, times in listed])
    counting, scoring = uuid.uuid4().hex, uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(held)
    counts = docs.select("text").mapInArrow(_count(counting, sent), "term long, docs long, terms long")
    counts = written(counts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")), "terms", _BATCH)
    corpus = counts.where("term < 0").first()
    if corpus is None or not corpus["docs"]:
        return None
    weight = F.floor(1000 * F.log((2 * F.lit(corpus["docs"]) + 2).cast("double") / (2 * F.col("docs") + 1)))
    weights = np.zeros(len(held["terms"]), np.int64)
    for row in counts.where("term >= 0").select("term", weight.alias("weight")).toLocalIterator():
        weights[row["term"]] = row["weight"]
    held |= {"weights": weights, "docs": corpus["docs"], "total": corpus["terms"], "n_items": len(ids), "k": k, "k1": k1, "b": b}
    sent = spark.sparkContext.broadcast(held)
    scored = docs.select("doc_id", "text").mapInArrow(_score(scoring, sent), "item long, score long, doc_id long")
    scored = written(scored.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_GROUPS))), "scores", _BATCH)
    few = _ranked(scored, ["item", "part"], k).select("item", "score", "doc_id")
    names = spark.createDataFrame(list(enumerate(ids)), rows.select(F.lit(0).cast("long").alias("item"), "item_id").schema)
    return _ranked(few, ["item"], k).join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    k1_per_mille: int = K1_PER_MILLE,
    b_per_cent: int = B_PER_CENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item, by integer scores.

    Items are dealt into blocks of about ``block_bytes`` of terms; each block is an automaton, a broadcast and
    two scans of ``docs``, so memory is bounded by the block, not by the items. All rows count: a null
    or empty text has no terms; rows that repeat a ``doc_id`` are documents of their own; a null
    ``doc_id`` ranks behind equal scores. Rows of ``items`` that repeat an id and text count
    once, different texts of one id form one item, as do those of a null id; items without terms, and documents that
    score 0, give no rows. Other columns are ignored; an empty table gives no rows.
    """
    found = (
        items.select("item_id", "text").distinct()
        .select("item_id", F.explode(terms_of(F.col("text"))).alias("term"))
        .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    )
    found = written(found, "item-terms")
    total = found.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    parts = []
    for block in range(blocks):
        rows = found.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        part = _block(docs, rows, k, k1_per_mille, b_per_cent) if total else None
        if part is not None:
            parts.append(part if blocks == 1 else written(part, "ranks"))
    if not parts:
        return found.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_lexical_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
