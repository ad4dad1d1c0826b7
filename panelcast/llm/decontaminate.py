"""Benchmark passages found by one automaton over normalised item windows."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.shared import table, written

#: A-Z to a-z, digits and a-z and all bytes of non-ASCII characters kept, the rest blank.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WINDOW = 10
#: Text of windows that one automaton may hold; more items make several automata.
AUTOMATON_BYTES = 16 << 20


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows(text: str | None, size: int = WINDOW) -> list[str]:
    """Windows of an item as blank-framed texts; a shorter item is one window, no words none."""
    words = [w.decode() for w in normal_words(text)]
    if not words:
        return []
    last = max(len(words) - size, 0)
    return [f" {' '.join(words[i : i + size])} " for i in range(last + 1)]


def windows_column(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(windows, na_action=None)

    return of(text)


_BUILT: dict[str, object] = {}


def _automaton(key: str, patterns: Broadcast):
    """The automaton of a broadcast, built once in each worker process; the last one is kept."""
    import ahocorasick

    if key in _BUILT:
        return _BUILT[key]
    _BUILT.clear()
    machine = ahocorasick.Automaton()
    for pattern, items in patterns.value.items():
        machine.add_word(pattern, (len(pattern), pattern.count(" ") - 1, items))
    machine.make_automaton()
    _BUILT[key] = machine
    return machine


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def scan(machine, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged word ranges that windows cover, and items found."""
    words = normal_words(text)
    if not len(machine) or not words:
        return len(words), [], set()
    line = f" {b' '.join(words).decode()} "
    ends, items = [], set()
    for end, (size, count, found) in machine.iter(line):
        ends.append((end - size + 1, count))
        items.update(found)
    if not ends:
        return len(words), [], items
    starts = np.concatenate([[0], 1 + np.cumsum([1 + len(w.decode()) for w in words])[:-1]])
    first = np.searchsorted(starts, [a + 1 for a, _ in ends], side="right") - 1
    return len(words), merged([(int(f), int(f) + n) for f, (_, n) in zip(first, ends, strict=True)]), items


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of the unchanged text for word ranges of its normal form."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    chars = lambda at: len(raw[:at].decode())
    return [(chars(places[a][0]), chars(places[b - 1][1])) for a, b in spans]


def _hits_column(patterns: Broadcast, texts: Column, spans: Column, items: Column) -> Column:
    key = uuid.uuid4().hex

    @F.pandas_udf("n_words long, spans array<long>, chars array<long>, items array<string>")
    def hits(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        machine = _automaton(key, patterns)
        rows = []
        for text, old, listed in zip(texts, spans, items, strict=True):
            n, new, found = scan(machine, text)
            both = merged([*zip(old[::2], old[1::2], strict=True), *new]) if len(old) else new
            chars = original_spans(text, both) if both else []
            rows.append(
                (n, [x for ab in both for x in ab], [x for ab in chars for x in ab], sorted(found.union(listed)))
            )
        return pd.DataFrame(rows, columns=["n_words", "spans", "chars", "items"])

    return hits(texts, spans, items)


def find_passages(docs: DataFrame, items: DataFrame, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with a column ``hits``: words, covered word ranges, their places in the text, items.

    The distinct windows of all items go into one automaton that every task scans each
    text with once. Windows beyond ``automaton_bytes`` of text are dealt by hash to
    several automata, one pass each, whose hits are merged, so nothing that is sent
    to executors outgrows the limit. Null or empty texts and items have no words;
    items without an id mark words but are not listed; repeated items count once; extra
    columns of ``docs`` stay, but for one called ``hits``, which is replaced.
    """
    spark = docs.sparkSession
    found = items.select(
        F.col("item_id").cast("string").alias("item"), F.explode(windows_column(F.col("text"))).alias("window")
    ).distinct()
    total = found.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    shards = max(1, -(-int(total) // automaton_bytes))
    out = docs.withColumn(
        "hits",
        F.lit(None).cast("struct<n_words:bigint,spans:array<bigint>,chars:array<bigint>,items:array<string>>"),
    )
    empty = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    for shard in range(shards):
        patterns: defaultdict[str, list[str]] = defaultdict(list)
        for row in found.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == shard).toLocalIterator():
            patterns[row["window"]].extend([row["item"]] if row["item"] is not None else [])
        sent = spark.sparkContext.broadcast(dict(patterns))
        before = (F.coalesce("hits.spans", empty[0]), F.coalesce("hits.items", empty[1])) if shard else empty
        out = out.withColumn("hits", _hits_column(sent, F.col("text"), *before))
        if shard + 1 < shards:
            out = written(out, "hits")
    return out


def hit_words(hits: Column) -> Column:
    """Words inside the covered ranges: ends minus starts."""
    signed = F.transform(hits["spans"], lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any item window; columns unchanged."""
    return find_passages(docs, items).where(F.size("hits.spans") == 0).select(*docs.columns)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: words, words hit by benchmark windows, and the items found."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = find_passages(docs, table(spark, folder, "benchmark"))
    listed = F.array_join(F.array_sort("hits.items"), ",")
    n_hit = hit_words(F.col("hits"))
    return rows.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
