"""Entity resolution over the whole security master, and the industry vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import nodes as N
from tideline.functions.names import explicit_ticker, normalize_industry, normalize_name
from tideline import settings as S


def name_index(master: DataFrame) -> DataFrame:
    """(norm_name, ticker, n): on a collision the larger cap wins, the first ticker on equal caps."""
    named = master.where(F.coalesce("name", F.lit("")) != "").withColumn(
        "norm_name", normalize_name(F.col("name")))
    rank = F.struct((-F.coalesce("market_cap", F.lit(0))).alias("k"), "ticker")
    return named.groupBy("norm_name").agg(F.min_by("ticker", rank).alias("ticker"),
                                          F.count("*").alias("n"))


def name_collisions(master: DataFrame, index: DataFrame) -> DataFrame:
    """Every ticker that shares its normalized name, one row each."""
    shared = index.where("n > 1").select("norm_name", F.col("ticker").alias("winner"))
    named = master.withColumn("norm_name", normalize_name(F.col("name")))
    return named.join(shared, "norm_name").select("norm_name", "ticker", "winner")


def resolve(names: DataFrame, master: DataFrame, index: DataFrame, col: str = "company") -> DataFrame:
    """Distinct names with the ticker they stand for; NULL ticker = unresolved.

    ``name(ticker)`` is taken at its word: when that ticker does not exist the name stays
    unresolved and is never looked up by its text.
    """
    asked = names.select(F.col(col).alias("company")).where(F.col("company").isNotNull()).distinct()
    asked = asked.withColumn("_explicit", explicit_ticker(F.col("company"))).withColumn(
        "_norm", F.when(F.col("_explicit").isNull(), normalize_name(F.col("company"))))
    # generated columns: a caller's filter on what is found would otherwise read and normalize the names ahead of the distinct
    asked = asked.select(F.inline(F.array(F.struct("company", "_explicit", "_norm"))))
    listed = master.select(F.col("ticker").alias("_listed"))
    by_name = index.select(F.col("norm_name").alias("_norm"), F.col("ticker").alias("_by_name"))
    # one branch per kind of name: a NULL join key would send all rows of the other kind to one task
    told = asked.where(F.col("_explicit").isNotNull()).join(listed, F.col("_explicit") == F.col("_listed"), "left")
    named = asked.where(F.col("_explicit").isNull()).join(by_name, "_norm", "left")
    return told.select("company", F.col("_listed").alias("ticker")).unionByName(
        named.select("company", F.col("_by_name").alias("ticker")))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("ticker").isNull()).select("company")


def near_misses(names: DataFrame, index: DataFrame, limit: int = 3) -> DataFrame:
    """Suggestions for unresolved names: listed names that share a long enough run of characters.

    Two names meet only if they share a character run of the minimum length (an equi join on runs),
    then the longest shared run is measured. (company, rank, norm_name, ticker, overlap, contained)
    """
    asked = names.select("company").distinct().withColumn("norm", normalize_name(F.col("company"))
                                                          ).where(F.length("norm") >= 2)
    # shortest run that counts: 2 for names up to three characters, 3 beyond
    asked = asked.withColumn("need", F.greatest(F.lit(2), F.least(F.length("norm"), F.lit(4)) - 1))
    runs = lambda s, k: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))),
        lambda i: F.substring(s, i, k)))
    q = asked.withColumn("run", F.explode(runs(F.col("norm"), F.col("need")))).where(
        F.length("run") == F.col("need"))
    lens = index.select("norm_name", "ticker").withColumn(
        "need", F.explode(F.array(F.lit(2), F.lit(3))))
    m = lens.withColumn("run", F.explode(runs(F.col("norm_name"), F.col("need")))).where(
        F.length("run") == F.col("need"))
    met = q.join(m, ["need", "run"]).where(F.col("norm") != F.col("norm_name")).select(
        "company", "norm", "norm_name", "ticker").distinct()
    starts = F.sequence(F.lit(1), F.length("norm"))
    longest = F.array_max(F.transform(starts, lambda i: F.aggregate(
        F.sequence(F.lit(1), F.length("norm") - i + 1), F.lit(0),
        lambda acc, k: F.when((k == acc + 1) & F.contains(
            F.col("norm_name"), F.substring(F.col("norm"), i, k)), k).otherwise(acc))))
    scored = met.withColumn("overlap", longest).withColumn(
        "contained", F.contains("norm_name", "norm") | F.contains("norm", "norm_name"))
    w = Window.partitionBy("company").orderBy(
        F.col("contained").desc(), F.col("overlap").desc(),
        F.abs(F.length("norm_name") - F.length("norm")), "norm_name")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "company", "rank", "norm_name", "ticker", "overlap", "contained")


# ---- industries ---------------------------------------------------------------------------

def industry_vocabulary(edges: DataFrame, map_rows: DataFrame) -> DataFrame:
    """Distinct industries named by edges (industry ends only) or by maps."""
    used = edges.where(F.col("rel").isin(S.REL_MEMBER, S.REL_UPSTREAM, S.REL_DOWNSTREAM)
                       & (N.node_kind(F.col("dst")) == "I"))
    parts = (used.select(N.node_value(F.col("dst")).alias("industry"))
             .unionByName(map_rows.select("industry"))
             .unionByName(map_rows.select(F.col("target").alias("industry"))))
    return parts.where(F.coalesce("industry", F.lit("")) != "").distinct()


def resolve_industries(names: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """names(name, pos) -> (name, industry, is_new).

    Alias, then the exact known name, then the known name with the same normalized form, then a new
    industry. Among new names with one normalized form the earliest stands for all.
    """
    asked = names.groupBy(F.trim("name").alias("name")).agg(F.min("pos").alias("pos")).where(
        F.col("name") != "")
    target = asked.join(aliases.select(F.col("alias").alias("name"), "target"), "name", "left"
                        ).select("name", "pos", F.coalesce("target", "name").alias("t")
                                 ).withColumn("norm", normalize_industry(F.col("t")))
    known = vocabulary.select(F.col("industry").alias("t"), F.lit(True).alias("exact"))
    by_norm = vocabulary.groupBy(normalize_industry(F.col("industry")).alias("norm")).agg(
        F.min("industry").alias("known_norm"))
    j = target.join(known, "t", "left").join(by_norm, "norm", "left")
    fresh = j.where(F.col("exact").isNull() & F.col("known_norm").isNull())
    first = fresh.groupBy("norm").agg(F.min_by("t", F.struct("pos", "t")).alias("first_new"))
    out = j.join(first, "norm", "left")
    return out.select("name", F.when(F.col("exact"), F.col("t")).otherwise(
        F.coalesce("known_norm", "first_new")).alias("industry"),
        (F.col("exact").isNull() & F.col("known_norm").isNull()).alias("is_new"))


def new_industry_counts(resolved: DataFrame) -> DataFrame:
    """How often names were given that fold into nothing known; needs resolved(name, n, ...)."""
    return resolved.where("is_new").groupBy("industry").agg(F.sum("n").alias("n"))


def alias_suggestions(fresh: DataFrame, vocabulary: DataFrame, min_len: int = 2) -> DataFrame:
    """(fresh, known) where one normalized form is a proper prefix of the other.

    Prefixes are generated and matched by equality, so no pair of names is compared needlessly.
    """
    f = fresh.select(F.col("industry").alias("fresh")).withColumn(
        "nf", normalize_industry(F.col("fresh"))).where(F.length("nf") >= min_len)
    k = vocabulary.select(F.col("industry").alias("known")).withColumn(
        "nk", normalize_industry(F.col("known")))
    heads = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.left(s, i))
    longer_k = k.where(F.length("nk") > 1).withColumn("nf", F.explode(heads(F.col("nk"))))
    longer_f = f.where(F.length("nf") > 1).withColumn("nk", F.explode(heads(F.col("nf"))))
    return (f.join(longer_k, "nf").select("fresh", "known")
            .unionByName(longer_f.join(k, "nk").select("fresh", "known")).distinct())
