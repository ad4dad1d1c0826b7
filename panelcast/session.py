"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app_name: str = "panelcast") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be lost together with the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="panelcast-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_in_place(df: DataFrame) -> DataFrame:
    """``cut_lineage`` that keeps a hash partitioning known, so later joins by it move nothing.

    An adaptive plan forgets how its result lies; the repartition before gives its number of partitions.
    """
    conf, setting = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(setting)
    conf.set(setting, "false")
    try:
        return cut_lineage(df)
    finally:
        conf.set(setting, before)


SMALL_SIDE_ROWS = 10_000


def small_side(df: DataFrame, limit: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Hint a broadcast for a join side only after counting it.

    The side is written out once, so the count and the join read the same rows.
    Above ``limit`` rows it is returned without a hint and joins by shuffle.
    """
    side = cut_lineage(df)
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side
