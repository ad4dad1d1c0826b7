"""Token ids as Parquet list columns: ordered, delta encoded, selectively readable."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelcast.llm.shared import shared_folder, table
from panelcast.llm.tokens import encoder, text_slices, tokenizer_path
from panelcast.session import small_side

#: Ids are delta encoded; the few-valued file number keeps a dictionary. Row groups and
#: pages are small enough to skip by the page index, which the writer always adds.
FILE_OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#ids.list.element": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.columnindex.truncate.length": "16",
    "compression": "zstd",
}

SCHEMA = "doc_id long, file int, file_start long, n_tokens long, ids array<int>"


def _encode_partition(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(path).encode_column
        start = 0
        for batch in batches:
            for rows in text_slices(batch):
                ids, offsets = encode_texts(rows.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("file"),
                        pa.array(start + offsets[:-1], pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4"))),
                    ],
                    ["doc_id", "file", "file_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    return encode


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, options: dict | None = None
) -> None:
    """Encode whole texts and write them as Parquet in ascending ``doc_id`` order.

    Files are ranges of ``doc_id`` and each is sorted, so file statistics and page
    indexes lead to a document. ``file_start`` counts the ids before a document in its
    own file; ``file`` numbers the files in order. Null and empty texts hold only the
    end id. Null ids come first, rows with equal ids stay next to each other in any
    order, other columns are ignored, and an empty table gives an empty folder.
    """
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .withColumn("file", F.spark_partition_id())
    )
    encoded = ordered.mapInArrow(_encode_partition(tokenizer_path(tokenizer), end_id), SCHEMA)
    encoded.write.options(**(FILE_OPTIONS | (options or {}))).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """Documents of a token folder with ``start``, the ids of all documents before them.

    Only the columns asked for are read: without ``ids`` the token pages stay untouched. The
    table of files is counted, and joined by broadcast while it is small.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = files.select(
        F.col("file"),
        (F.sum("in_file").over(Window.orderBy("file")) - F.col("in_file")).alias("before"),
    )
    return rows.join(small_side(before), "file").select(
        "doc_id", (F.col("before") + F.col("file_start")).alias("start"), *columns
    )


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op1_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the written files: position, length and checksum of its ids."""
    out = shared_folder(spark, "op1-tokens")
    write_tokens(table(spark, folder, "documents"), out)
    rows = read_tokens(spark, out)
    return rows.mapInArrow(_crc_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
