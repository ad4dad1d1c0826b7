"""Best-fit packing after a Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the packing is solved on the count of each
length: a table of at most ``capacity`` rows whatever the corpus. Pieces are then placed
by their number among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.llm.shared import table, written
from panelcast.llm.tokens import encoder, text_slices, tokenizer_path

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local long"


def _cut_partition(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(path).encode_column
        seen: Counter[int] = Counter()
        for rows in (x for batch in batches for x in text_slices(batch)):
            flat, offsets = encode_texts(rows.column("text"))
            flat, offsets = np.insert(flat, offsets[1:], end_id), (offsets + np.arange(len(offsets))).tolist()
            out: list[tuple] = []
            docs = zip(rows.column("doc_id").to_pylist(), rows.column("part").to_pylist(), strict=True)
            for (doc_id, part), low, high in zip(docs, offsets, offsets[1:], strict=False):
                ids, n = flat[low:high], high - low
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    out.append((doc_id, piece, a, b - a, zlib.crc32(ids[a:b]), part, seen[b - a]))
                    seen[b - a] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"],
            )

    return cut


def _largest(counts: dict[int, int], at_most: int) -> int:
    return max((x for x, n in counts.items() if n and x <= at_most), default=0)


def _best_sum(counts: dict[int, int], room: int) -> int:
    """The largest total of items that fits in ``room``; bit i of ``sums`` is a total of i."""
    sums, mask = 1, (2 << room) - 1
    for size, n in counts.items():
        n, step = min(n, room // size), 1
        while n > 0:
            sums |= (sums << (size * min(step, n))) & mask
            n, step = n - step, 2 * step
    return sums.bit_length() - 1


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that some optimal packing contains, and the counts left over.

    For each length, longest first: an item and its largest partner are fixed together
    when no set of other items that fits beside the item is longer in total than the
    partner. Whatever an optimal packing put beside the item then fits in the partner's
    old place, so exchanging them costs nothing. An item beside which nothing fits
    is fixed alone. Fixing items only removes rivals, so a set that dominates goes on
    dominating while both lengths last.
    """
    left = {x: n for x, n in counts.items() if n}
    fixed: list[tuple[tuple[int, ...], int]] = []
    for top in sorted(left, reverse=True):
        while left.get(top):
            rest = {x: n - (x == top) for x, n in left.items()}
            partner = _largest(rest, capacity - top)
            if partner and top + partner < capacity and _best_sum(rest, capacity - top) > partner:
                break
            if not partner:
                times, used = left[top], ((top, left[top]),)
                fixed.append(((top,), times))
            else:
                times = left[top] // 2 if partner == top else min(left[top], left[partner])
                used = ((top, times), (partner, times))
                fixed.append(((top, partner), times))
            for size, n in used:
                left[size] -= n
            left = {x: n for x, n in left.items() if n}
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of all items, longest first, on groups of equally filled sequences."""
    open_groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            room = min((r for r, groups in open_groups.items() if r >= size and groups), default=None)
            held, n = open_groups[room].pop() if room is not None else ((), None)
            room = capacity if room is None else room
            # Best fit goes on with the sequence it has just filled while the item fits.
            each = room // size
            if n is None:
                n = todo // each if todo >= each else 1
            whole = min(n, todo // each)
            if whole:
                open_groups.setdefault(room - each * size, []).append((held + (size,) * each, whole))
                todo -= whole * each
            if whole < n:
                rest = n - whole
                if todo:
                    open_groups.setdefault(room - todo * size, []).append((held + (size,) * todo, 1))
                    todo, rest = 0, rest - 1
                if rest and held:
                    open_groups.setdefault(room, []).append((held, rest))
    return [g for groups in open_groups.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first number, count, first sequence, offset) that place every piece."""
    fixed, left = dominance_reduction(counts, capacity)
    rows, used, sequence = [], Counter(), 0
    for pattern, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for size in pattern:
            rows.append((size, used[size], times, sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return rows


def _place(rows: list[tuple[int, int, int, int, int]]):
    by_length: dict[int, np.ndarray] = {}
    for size in {r[0] for r in rows}:
        by_length[size] = np.array(sorted(r[1:] for r in rows if r[0] == size), dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for size in np.unique(lengths):
                mine = np.flatnonzero(lengths == size)
                slots = by_length[int(size)]
                k = np.searchsorted(slots[:, 0], numbers[mine], side="right") - 1
                sequence[mine] = slots[k, 2] + numbers[mine] - slots[k, 0]
                offset[mine] = slots[k, 3]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return place


def pack(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A document longer than ``capacity`` is cut into full pieces behind a first piece of
    the remainder; no other is cut. Null and empty texts are one piece of the end id.
    Rows with equal or null ids are packed each on their own, other columns are ignored,
    and an empty table gives no rows.
    """
    parts = docs.select("doc_id", "text").withColumn("part", F.spark_partition_id())
    pieces = written(parts.mapInArrow(_cut_partition(tokenizer_path(tokenizer), end_id, capacity), PIECES), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part")
    bases = per_part.select("part", "length", (F.sum("n").over(earlier) - F.col("n")).alias("base"))
    # At most one row for each length up to the capacity.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    numbered = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("base") + F.col("local")).alias("number")
    )
    return numbered.mapInArrow(
        _place(plan(counts, capacity)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in its sequence of at most 1024 tokens."""
    return pack(table(spark, folder, "documents"))
