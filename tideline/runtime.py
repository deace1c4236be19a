"""Session and lineage helpers shared by the jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows of per-row pattern matching in one task, about ten seconds of it.
ROWS_A_TASK = 100_000


def local_session(app_name: str = "tideline", cpus: str | None = None,
                  shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark. A cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one the cluster names in spark.checkpoint.dir.

    Only a local session, whose tasks share the driver's disk, may fall back to a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job in reliable shared storage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(table: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Deal rows of costly per-row work evenly by a unique key, at every size of the table.

    A file of texts is one split, however its rows differ in length; one shuffle of the texts costs
    less than a task that holds most of the pattern matching. With the number of ``rows`` a task
    holds ``ROWS_A_TASK`` of them at most, so the longest task does not grow with the table.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(parts, -(-rows // ROWS_A_TASK)), *keys)
