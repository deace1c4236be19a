"""News and filings around a name: only relevant items, newest first, within a quota."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions.documents import market_relevant, strip_tags

CFG = S.NewsSettings()


def scored_news(items: DataFrame, as_of: str, days: int = CFG.days) -> DataFrame:
    """items(name, title, description, link, ts) inside the age limit, cleaned, with ``relevant``."""
    fresh = items.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days"))
    clean = fresh.withColumns({"title": strip_tags(F.coalesce("title", F.lit(""))),
                               "description": strip_tags(F.coalesce("description", F.lit("")))})
    return clean.withColumn("relevant", market_relevant(F.col("name"), F.col("title"), F.col("description")))


def news_quota(scored: DataFrame, per_name: int = CFG.per_name) -> DataFrame:
    """The newest relevant items of each name (window group limit keeps hot names cheap)."""
    w = Window.partitionBy("name").orderBy(F.col("ts").desc(), "link")
    return scored.where("relevant").withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= per_name)


def news_stats(scored: DataFrame, per_name: int = CFG.per_name) -> DataFrame:
    """(name, raw, kept, all_noise): items looked at until the quota filled, and items kept.

    The position at which the quota fills is the time of the last kept item, so no running count
    over a name's whole feed is needed.
    """
    last = news_quota(scored, per_name).groupBy("name").agg(
        F.count("*").alias("kept"), F.max_by(F.struct("ts", "link"), "rank").alias("last"))
    j = scored.join(last.select("name", "kept", F.col("last.ts").alias("lts"),
                                F.col("last.link").alias("llink")), "name", "left")
    kept = F.coalesce(F.col("kept"), F.lit(0))
    looked = (kept < per_name) | (F.col("ts") > F.col("lts")) | (
        (F.col("ts") == F.col("lts")) & (F.col("link") <= F.col("llink")))
    return j.groupBy("name").agg(F.count_if(looked).alias("raw"), F.max(kept).alias("kept")).withColumn(
        "all_noise", (F.col("kept") == 0) & (F.col("raw") > 0))


def recent_filings(filings: DataFrame, as_of: str, days: int = CFG.filing_days) -> DataFrame:
    """Filings of the last ``days`` days up to the as-of date."""
    end = F.lit(as_of).cast("date")
    return filings.where(F.col("filed").between(F.date_sub(end, days), end))
