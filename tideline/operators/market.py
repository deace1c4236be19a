"""Market-level series and master quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.numbers import positive_or_zero, ratio


def market_return(rets: DataFrame, caps: DataFrame | None = None) -> DataFrame:
    """(dt_idx, ret): cap-weighted mean return of the tickers observed that day.

    A missing or non-positive cap weighs nothing. A day without weight is NULL; when no ticker has
    a usable cap at all, the mean is unweighted.
    """
    if caps is None:
        return rets.groupBy("dt_idx").agg(F.avg("ret").alias("ret"))
    weighted = rets.join(caps.select("ticker", "market_cap"), "ticker", "left").withColumn(
        "w", positive_or_zero(F.col("market_cap")))
    seen = F.col("ret").isNotNull()
    days = weighted.groupBy("dt_idx").agg(
        F.sum(F.col("w") * F.col("ret")).alias("num"), F.sum(F.when(seen, F.col("w"))).alias("den"),
        F.sum("w").alias("any_w"), F.avg("ret").alias("plain"))
    # one row per calendar day
    total = F.sum("any_w").over(Window.partitionBy(F.lit(0)))
    return days.select("dt_idx", F.when(total > 0, ratio(F.col("num"), F.col("den")))
                       .otherwise(F.col("plain")).alias("ret"))


def padded_returns(panel: DataFrame) -> DataFrame:
    """Returns with halted days carried forward: 0 while halted, the whole move on return.

    Only rows that traded exist here; a halted day adds (ret 0) rows between two trades, so gaps
    are filled by generating the missing day positions per ticker (bounded by the calendar).
    """
    w = Window.partitionBy("ticker").orderBy("dt_idx")
    nxt = F.coalesce(F.lead("dt_idx").over(w), F.col("n_days"))
    traded = panel.select("ticker", "dt_idx", (F.col("close") / F.lag("close").over(w) - 1)
                          .alias("ret"), nxt.alias("until"), "n_days")
    filled = traded.withColumn("k", F.explode(F.sequence(F.col("dt_idx"), F.col("until") - 1)))
    return filled.select("ticker", F.col("k").alias("dt_idx"), "n_days",
                         F.when(F.col("k") == F.col("dt_idx"), F.col("ret"))
                         .otherwise(F.lit(0.0)).alias("ret"))


def master_quality(master: DataFrame, min_named: float = 0.9) -> DataFrame:
    """One row: named share of the master and whether it deserves a warning."""
    named = F.count_if(F.col("name").isNotNull() & (F.col("name") != ""))
    return master.agg(F.count("*").alias("n_rows"), named.alias("n_named")).withColumn(
        "warn", F.col("n_named") < F.col("n_rows") * min_named)
