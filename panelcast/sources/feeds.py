"""Feeds that grow: new and changed files are read once, and committed by a manifest.

A store holds the rows of every batch as Parquet and a manifest of the files in it. A batch counts only once its
manifest is written, after its rows, so a run that dies leaves nothing behind that is ever read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelcast.sources.readers import files_by_header, read_with_header
from panelcast.sources.schemas import CSV_SCHEMAS

_FILES = "path STRING, source_file STRING, modified TIMESTAMP, size BIGINT, batch BIGINT"


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """Every version of every file read so far, with its batch."""
    try:
        return spark.read.schema(_FILES).parquet(f"{store}/manifest/*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], _FILES)


def new_files(spark: SparkSession, path: str | list[str], store: str) -> DataFrame:
    """Files whose name, size or time of change is not in the manifest; contents are not read."""
    listed = spark.read.format("binaryFile").load(path).select(
        "path", F.col("_metadata.file_path").alias("source_file"), F.col("modificationTime").alias("modified"),
        F.col("length").alias("size"),
    )
    return listed.join(manifest(spark, store).drop("batch", "source_file"), ["path", "modified", "size"], "left_anti")


def refresh(spark: SparkSession, path: str | list[str], store: str, kind: str = "poll_feed") -> int:
    """Adds the new and changed files that ``path`` names as one batch; the number of these files.

    Rows come in the declared columns of ``kind`` whatever the header of their file. Empty files are left out
    until they have content.
    """
    schema = CSV_SCHEMAS[kind]
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    found = new_files(spark, path, store).collect()
    if not found:
        return 0
    batch = (manifest(spark, store).agg(F.max("batch")).first()[0] or 0) + 1
    headers = files_by_header(spark, [r["path"] for r in found])
    parts = [read_with_header(spark, files, header, declared) for header, files in headers.items()]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{store}/rows/batch={batch}")
    noted = spark.createDataFrame([(r["path"], r["source_file"], r["modified"], r["size"], batch) for r in found], _FILES)
    noted.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/{batch}")
    return len(found)


def current(spark: SparkSession, store: str, kind: str = "poll_feed") -> DataFrame:
    """Rows of the last committed version of every file, in the declared columns."""
    schema = CSV_SCHEMAS[kind]
    declared = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    last = manifest(spark, store).groupBy("source_file").agg(F.max("batch").alias("batch"))
    if last.isEmpty():
        return spark.createDataFrame([], declared)
    stored = StructType([*declared.fields]).add("source_file", "string").add("batch", "long")
    rows = spark.read.schema(stored).option("basePath", f"{store}/rows").parquet(f"{store}/rows/*")
    return rows.join(last, ["source_file", "batch"]).select(*declared.fieldNames())
