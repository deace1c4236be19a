"""A corpus through five stages: language, boilerplate lines, near duplicates, test items, source mix.

Each stage works on all documents that its predecessor kept, and is written as Parquet before the next
one reads it. The last one returns the documents of the mix with their numbers of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import queries
from tideline.llm.common import staged, table

STAGES = [
    ("language_id", queries.language_stage),
    ("line_dedup", queries.line_stage),
    ("near_dedup", queries.simhash_stage),
    ("decontamination", queries.contamination_stage),
    ("source_mix", queries.mix_stage),
]

#: Learned and hashed stages can't be said in SQL; tests hold each stage against a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
