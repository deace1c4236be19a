"""Tables that several operators of a run read: built once, written, read back.

A panel or an edge table is far smaller than the rows it is built from, and a run reads it many
times. Each one is written once per session as parquet in the shared folder that the cluster names
in ``spark.checkpoint.dir``. That cuts lineage, survives lost executors, keeps column pruning, and
gives the optimizer real sizes to choose joins by.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tideline.runtime import shared_folder

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}
_FILES: dict[tuple[str, str, str], str] = {}


def kept(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        name = f"{fn.__module__.rsplit('.', 1)[-1]}_{fn.__name__}"
        key = (app, sf_dir, name)
        if key not in _WRITTEN:
            df = fn(spark, sf_dir)
            path = f"{shared_folder(spark)}/tideline-{app}/{len(_WRITTEN)}-{name}"
            df.write.mode("overwrite").parquet(path)
            _WRITTEN[key] = spark.read.schema(df.schema).parquet(path)
        return _WRITTEN[key]
    return get


def dealt_by_file(lines: DataFrame) -> DataFrame:
    """(file, value) with the rows of a file together; a large file is split, by measured sizes."""
    return lines.select("file", "value").hint("rebalance", "file")


def kept_files(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], str]:
    """Writes the lines of ``fn``'s (file, value) once, below a folder per file name; gives the path of all.

    ``fn`` deals the rows out, so that a file's rows are in few tasks.
    """
    @wraps(fn)
    def get(spark: SparkSession, sf_dir: str) -> str:
        app = spark.sparkContext.applicationId
        key = (app, sf_dir, f"{fn.__module__.rsplit('.', 1)[-1]}_{fn.__name__}")
        if key not in _FILES:
            path = f"{shared_folder(spark)}/tideline-{app}/files-{len(_FILES)}-{uuid.uuid4().hex}"
            fn(spark, sf_dir).select("file", "value").write.partitionBy("file").text(path, compression="gzip")
            _FILES[key] = path
        return _FILES[key]
    return get


def forget() -> None:
    """Build the shared tables anew from here on (fresh inputs, or a timing run)."""
    _WRITTEN.clear()
    _FILES.clear()


def new_run(label: str) -> str:
    """Name of a run that no other run has, so that runs of the same day never meet in a folder."""
    return f"{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, run: str) -> str:
    return f"{shared_folder(spark)}/tideline-{spark.sparkContext.applicationId}/run-{run}"


def staged(df: DataFrame, run: str, name: str) -> DataFrame:
    """Write an intermediate table of a run (see ``new_run``) to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{_folder(spark, run)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, run: str) -> None:
    """Delete the staged tables of a run; DataFrames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, run))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Run(dict):
    """Result tables of a run by name. They read its staged tables until ``discard`` is called."""

    def __init__(self, tables: dict[str, DataFrame], spark: SparkSession, run: str):
        super().__init__(tables)
        self.spark, self.run = spark, run

    def discard(self) -> None:
        discard(self.spark, self.run)
