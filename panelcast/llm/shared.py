"""Tables, written intermediate results and words shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from panelcast.session import ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there.

    The files stay until the checkpoint folder is cleared, so that a lost
    executor costs a task and never the table. ``batch_rows`` holds for this one write: rows
    that go to Python at once, fewer where rows are long.
    """
    spark, setting = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    folder, before = shared_folder(spark, name), spark.conf.get(setting)
    if batch_rows:
        spark.conf.set(setting, str(batch_rows))
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(folder)


class WordHashes:
    """64-bit hashes of words, each distinct word hashed once while it is remembered."""

    def __init__(self, limit: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def cuts(lengths: Iterable[int]) -> np.ndarray:
    """Offsets of consecutive runs of the given lengths, with the total at the end."""
    sizes = np.fromiter(lengths, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows with equal first ``keys`` columns, from batches sorted by them.

    One group is held at a time; lists come as NumPy arrays.
    """
    current, rows = None, []
    for batch in batches:
        columns = []
        for column in batch.columns:
            if pa.types.is_list(column.type):
                flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                columns.append([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
            else:
                columns.append(column.to_pylist())
        for row in zip(*columns, strict=True):
            if row[:keys] != current:
                if rows:
                    yield current, rows
                current, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield current, rows


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key next to each other in one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
