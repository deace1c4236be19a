"""Helpers that several operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.runtime import shared_folder

#: A word is a run of anything but the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be sent to every executor. Its callers have a few numbers per row.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the folder all executors share and read it back.

    Every call has a folder of its own, so no run can overwrite what another one reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", grows: bool = False) -> DataFrame:
    """Join with a written table `right` that has one row per key.

    It is broadcast only when its counted rows are few; beyond that Spark shuffles both sides and
    splits skewed keys of `left` at run time. A table that `grows` as the documents do is shuffled at
    every size.
    """
    if grows:
        return left.join(right.hint("merge"), on, how)
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, on, how)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo `parts`; a null doc_id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def id_key(doc_id: Column) -> Column:
    """doc_id as a join key that is never null."""
    return F.coalesce(doc_id.cast("string"), F.lit("-"))


def text_key(text: Column) -> Column:
    """64-bit key of a text; null has one of its own."""
    return F.xxhash64(F.coalesce(F.md5(text.cast("binary")), F.lit("-")))


def packed(docs: DataFrame) -> DataFrame:
    """(doc, id_key, text_key): whole rows as one struct, so that no column of theirs meets a helper's; `doc.*` unpacks them."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    return docs.select(whole, id_key(F.col("doc_id")).alias("id_key"), text_key(F.col("text")).alias("text_key"))


def lowered_words(text: bytes | None) -> list[bytes]:
    """ASCII-lowered words of a UTF-8 text: bytes.split() cuts at exactly the six space characters."""
    return text.lower().split() if text else []


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside pass at most so many rows to Python at a time; for tables of large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Sink:
    """Collects rows and hands them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 20_000):
        self.schema, self.rows = schema, rows
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    @property
    def full(self) -> bool:
        return len(self.columns[0]) >= self.rows

    def take(self) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return batch


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a long, b long) links: one row (node, label), label the smallest node.

    Alternating large-star and small-star contraction. Each round is written to the shared folder,
    which cuts the lineage; only a count and a checksum per round reach the driver. Nodes without a
    link to another node have no row. Empty links give an empty table.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    for k in range(rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if mark == last or not mark[0]:
            break
        last = mark
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = staged(small, f"round-{k}")
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
