"""The ten operators over their whole tables, by query name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import chat_format, contamination, language, line_spread, near_vectors, passages, phrases, pitman_yor, quality, simhash, source_mix, topk, vector_codes
from tideline.llm.common import fold, id_key, looked_up, packed, staged, table, text_key


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels outside the held-out third; null and empty texts are scored too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    return quality.score(docs, quality.learn(docs, labels))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    return pitman_yor.score(docs, pitman_yor.learn(docs.where("not held_out")), ["doc_id", "held_out"])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return source_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.repeated_passages(docs).drop("id_key", "text_key")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text", "lang")
    model = language.learn(docs.where("not held_out").select("lang", "text"))
    return language.predict(docs.select("doc_id", "held_out", "text", language.has_letter(F.col("text")).alias("letters")), model)


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "shared", "item_shingles", "containment")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat_format.digest(chat_format.format_conversations(turns))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = staged(simhash.fingerprints(docs, "doc_id"), "fp")
    return simhash.near_duplicates(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every query row; null or non-finite vectors take no part, an empty table gives no rows."""
    vectors = topk.numbered(topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = line_spread.without_boilerplate(docs)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 among all embeddings, whatever their labels; unusable vectors stay alone."""
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language over all documents; null langs are und, null texts empty."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable embeddings; null or non-finite vectors have no row, an empty table gives none.

    Null labels share one label_error, repeated rows count each, ties of distance go to the lower entry.
    """
    rows, book = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(book)).alias("codebooks_sha256"))


def all_queries():
    return {f.__name__: f for f in (op1_quality, op2_lm_score, op3_source_mix, op4_repeated_passages, op5_language, op6_contamination, op7_chat_format, op8_simhash, op9_topk, op10_line_spread,
                                    op11_near_vectors, op12_phrases, op13_vector_codes)}


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: `und` and predictions of posterior under one half go.

    Learns from the stage's own documents with a lang; without any, nothing can be told and all stay.
    """
    model = language.learn(docs.select("lang", "text"))
    if not model.languages:
        return docs
    rows = docs.select(id_key(F.col("doc_id")).alias("id_key"), text_key(F.col("text")).alias("text_key"), "text", language.has_letter(F.col("text")).alias("letters"))
    told = language.predict(rows, model).where("lang_pred = 'und' or score < 0.5").select("id_key", "text_key").distinct()
    return looked_up(packed(docs), staged(told, "rejected"), ["id_key", "text_key"], "left_anti").select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; columns as they came, but for text and n_chars."""
    return line_spread.without_boilerplate(docs, counts=False)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group, the smallest doc_id, with all columns; null and empty texts are one group."""
    return simhash.one_of_each(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all columns; null and empty texts stay."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with `copies`, from 1 to 3; sources by code point weigh 1, 2, 3, repeating, null last."""
    return source_mix.mixed_documents(docs)
