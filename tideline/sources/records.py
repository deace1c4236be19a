"""JSON records: edge lines, prediction cases, stored analyses; and the sinks of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.disclosures import latest_extractions
from tideline.operators.graph import EDGE_COLUMNS, EDGE_SCHEMA

BENEFICIARY = ("name string, ticker string, impact string, priced_in string, gap double, "
               "graph_backed boolean, via string, reason string, comment string")
ANALYSIS_SCHEMA = (
    "cause_summary string, cause_type string, cause_scope string, industry string, evidence string, "
    "confidence string, ripple_axis string, ripple_paths array<struct<direction: string, "
    "target_industry: string, logic: string, beneficiaries: array<struct<name: string, impact: string, "
    "reason: string>>>>")
IDEAS = ("array<struct<title: string, axis: string, driver: string, path: string, watch_points: string, "
         "beneficiaries: array<struct<name: string, ticker: string, impact: string, priced_in: string, "
         "gap: double, graph_backed: boolean, via: string, comment: string>>>>")
SYNTHESIS_SCHEMA = f"market_summary string, ideas {IDEAS}"
CASE_SCHEMA = f"base_date string, synthesis struct<market_summary: string, ideas: {IDEAS}>"
_BAD = "_corrupt string"


def _parsed(df: DataFrame, col: str, schema: str) -> DataFrame:
    rec = F.from_json(F.col(col), f"{schema}, {_BAD}",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return df.withColumn("rec", rec)


def parse_lines(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Parsed rows as column ``rec``; lines that are not valid JSON of this shape are skipped."""
    return _parsed(df, col, schema).where(F.col("rec").isNotNull() & F.col("rec._corrupt").isNull())


def rejected_lines(df: DataFrame, col: str, schema: str) -> DataFrame:
    """The rows that ``parse_lines`` skips, as they came."""
    bad = F.col("rec").isNull() | F.col("rec._corrupt").isNotNull()
    return _parsed(df, col, schema).where(bad).drop("rec")


def file_name(path: Column) -> Column:
    """Name of a file; of its folder where a table was written to a folder named like a JSON file."""
    named = F.regexp_extract(path, r"([^/=]+\.jsonl?)(?:/part-[^/]*)?$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.substring_index(path, "/", -1))


def text_files(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(file, value): the lines, or the whole texts, of all files below ``path``; blank ones are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=whole)
    return rows.where(F.trim("value") != "").select(file_name(F.col("_metadata.file_path")).alias("file"), "value")


def read_extractions(spark: SparkSession, path: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """((ticker, payload, file) of the entry that counts, rejects(file, value)).

    A file, or each line of it without ``whole``, is one object {ticker: extraction}. The last file by
    name replaces the whole entry of a ticker; within a file the greatest payload by letter stands.
    Texts that are no such object are rejects, never an error.
    """
    rows = text_files(spark, path, whole).withColumn("m", F.from_json("value", "map<string, string>"))
    said = rows.where("m is not null").select("file", F.explode("m").alias("ticker", "payload"))
    return latest_extractions(said), rows.where("m is null").drop("m")


def parse_edge_lines(df: DataFrame, col: str) -> DataFrame:
    return parse_lines(df, col, EDGE_SCHEMA).select(*[F.col(f"rec.{c}").alias(c) for c in EDGE_COLUMNS])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edge_lines(text_files(spark, path), "value")


def rejected_edges(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the lines that hold no edge."""
    return rejected_lines(text_files(spark, path), "value", EDGE_SCHEMA)


def write_edges(edges: DataFrame, path: str) -> None:
    """One JSON object per line, keys in alphabetical order."""
    edges.select(F.to_json(F.struct(*sorted(EDGE_COLUMNS)), {"ignoreNullFields": "false"}).alias("value")
                 ).write.mode("overwrite").text(path)


def case_date(file_name: Column) -> Column:
    """Date of a case file named 2*.json, NULL for other files or an impossible date."""
    stem = F.regexp_extract(file_name, r"(?:^|/)(2[^/]*)\.json$", 1)
    return F.when(stem.rlike(r"^\d{8}$"), F.try_to_timestamp(stem, F.lit("yyyyMMdd")).cast("date"))


def read_cases(df: DataFrame, file_col: str = "file", col: str = "content") -> DataFrame:
    """(base_date, synthesis) of well-formed case documents."""
    dated = df.withColumn("base_date", case_date(F.col(file_col))).where(F.col("base_date").isNotNull())
    return parse_lines(dated, col, CASE_SCHEMA).select("base_date", F.col("rec.synthesis").alias("synthesis"))


def load_cases(spark: SparkSession, path: str, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """((base_date, synthesis), rejects(file, value)) of the case files below ``path``.

    Files not named as a date are no cases and no rejects.
    """
    files = text_files(spark, path, whole)
    return (read_cases(files, "file", "value"),
            rejected_lines(files.where(case_date(F.col("file")).isNotNull()), "value", CASE_SCHEMA))


def save_by_date(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace only the dates present in ``df``; other dates stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("base_date").format(fmt).save(path))
