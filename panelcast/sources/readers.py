"""Scans: Parquet tables, typed CSV files, refreshed feeds, padded spreadsheets."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelcast.functions.cleaning import drop_subheader
from panelcast.sources.schemas import CSV_SCHEMAS, TABLE_SCHEMAS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; pruning and filters reach the scan."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str | list[str], schema: str | StructType, null_value: str = "NA"
) -> DataFrame:
    """Header CSV with a declared schema and no inference pass.

    Columns are matched by each file's own header, so files with more columns or
    another order still land in the declared ones.
    """
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    parts = [
        read_with_header(spark, files, header, declared, null_value).drop("source_file")
        for header, files in files_by_header(spark, path).items()
    ]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], declared)


def read_with_header(
    spark: SparkSession, files: list[str], header: tuple[str, ...], declared: StructType, null_value: str = "NA"
) -> DataFrame:
    """Files of one header line in the declared columns, with the ``source_file`` of every row."""
    lookup = {c.lower(): i for i, c in enumerate(header)}
    missing = [f.name for f in declared.fields if f.name.lower() not in lookup]
    if missing:
        raise ValueError(f"columns missing from {files}: {missing}")
    by_place = ", ".join(f"c{i} STRING" for i in range(len(header)))
    rows = spark.read.schema(by_place).option("header", True).option("nullValue", null_value).csv(files)
    return rows.select(
        *[F.col(f"c{lookup[f.name.lower()]}").try_cast(f.dataType).alias(f.name) for f in declared.fields],
        F.col("_metadata.file_path").alias("source_file"),
    )


def files_by_header(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files that a path, glob or list names, grouped by their own header line; empty files have none.

    Spark takes the first file's header for all files of a read, by position; files
    with another header therefore get a read of their own. One distributed job finds the first line
    of every file; what comes to the driver is each file's name and header.
    """
    names = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(names.join(first, "file").select("path", "header").collect()):
        header = row["header"].removeprefix("\ufeff")
        found.setdefault(tuple(c.strip() for c in next(csv.reader([header]), [])), []).append(row["path"])
    return found


def read_source(spark: SparkSession, kind: str, path: str | list[str]) -> DataFrame:
    """A CSV input by kind (see ``schemas.CSV_SCHEMAS``)."""
    return read_csv(spark, path, CSV_SCHEMAS[kind])


def read_feed(spark: SparkSession, path: str, kind: str = "poll_feed") -> DataFrame:
    """A feed that is rewritten often: the files a path or glob names at read time.

    Fetching over HTTP is left to whatever lands the file on shared storage.
    """
    return read_source(spark, kind, path)


def read_padded_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str],
    measures: Sequence[str],
) -> DataFrame:
    """A spreadsheet export with preamble lines above and footnotes below the table.

    Line positions have no meaning in a distributed read, so the padding is told
    apart by content: a data row carries a number in at least one measure.
    ``columns`` names the file's columns from left to right.
    """
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    raw = spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").csv(path)
    return drop_subheader(raw, measures)
