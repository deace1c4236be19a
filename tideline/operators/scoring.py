"""Scoring past predictions against later prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions.numbers import safe_corr
from tideline.operators.order_stats import exact_median, largest


def min_age_days(horizon: int) -> int:
    return int(horizon * 1.7) + 7


def aged_predictions(cases: DataFrame, as_of: str, min_age: int) -> DataFrame:
    """One row per beneficiary of a case that is old enough to score; a ticker is required."""
    old = cases.where(F.col("base_date") <= F.date_sub(F.lit(as_of).cast("date"), min_age))
    ideas = old.select("base_date", F.explode("synthesis.ideas").alias("i"))
    b = ideas.select("base_date", F.col("i.title").alias("idea"), F.col("i.axis").alias("axis"),
                     F.explode("i.beneficiaries").alias("b"))
    return b.where(F.coalesce("b.ticker", F.lit("")) != "").select(
        "base_date", "idea", "axis", "b.name", "b.ticker",
        F.coalesce("b.impact", F.lit(S.IMPACT_GAIN)).alias("impact"), "b.priced_in", "b.gap",
        "b.graph_backed", "b.via")


def forward_returns(keys: DataFrame, prices: DataFrame, horizon: int) -> DataFrame:
    """(ticker, base_date, forward_return) for keys(ticker, base_date).

    The base is the first traded day from the base date on, the end the ``horizon``-th traded day
    after it; both must lie within the lookup window, a shorter history gives no row. Every traded
    day answers for the days since the previous trade, so predictions meet prices by equality.
    """
    window = int(horizon * 1.7) + 14
    w = Window.partitionBy("ticker").orderBy("day")
    traded = prices.where(F.col("close") > 0).select("ticker", "day", "close").withColumns({
        "end_close": F.lead("close", horizon).over(w), "end_day": F.lead("day", horizon).over(w),
        "prev_day": F.lag("day").over(w)}).where(
            F.col("end_day").isNotNull() & (F.datediff("end_day", "day") <= window))
    first = F.greatest(F.date_sub("end_day", window),
                       F.coalesce(F.date_add("prev_day", 1), F.date_sub("end_day", window)))
    answers = traded.where(first <= F.col("day")).select(
        "ticker", F.explode(F.sequence(first, F.col("day"))).alias("base_date"),
        (F.col("end_close") / F.col("close") - 1).alias("forward_return"))
    asked = keys.select("ticker", "base_date").distinct()
    return asked.join(answers, ["ticker", "base_date"])


def score_rows(predictions: DataFrame, forward: DataFrame) -> DataFrame:
    return predictions.join(forward, ["ticker", "base_date"])


def _dimensions(scored: DataFrame) -> DataFrame:
    """Each scored row once per dimension it belongs to."""
    one = lambda dim, value: F.struct(F.lit(dim).alias("dim"), value.cast("string").alias("value"))
    only = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c))
    backed = F.when(F.col("graph_backed"), S.PROVENANCE_GRAPH).when(
        ~F.col("graph_backed"), S.PROVENANCE_MODEL)
    dims = F.array(one("overall", F.lit("")), one("priced_in", only("priced_in", S.PRICED_IN)),
                   one("axis", only("axis", S.IDEA_AXES)),
                   one("impact", only("impact", (S.IMPACT_GAIN, S.IMPACT_LOSS))),
                   one("provenance", backed), one("path", F.nullif("via", F.lit(""))))
    return scored.withColumn("d", F.explode(dims)).where(F.col("d.value").isNotNull()).select(
        *scored.columns, "d.dim", "d.value")


def summary(scored: DataFrame, min_path_n: int = 3) -> DataFrame:
    """n, mean, median and hit rate per dimension value; paths need ``min_path_n`` rows."""
    agg = _dimensions(scored).groupBy("dim", "value").agg(
        F.count("*").alias("n"), F.avg("forward_return").alias("mean"),
        F.avg((F.col("forward_return") > 0).cast("double")).alias("hit_rate"))
    med = exact_median(scored, ["dim", "value"], "forward_return", each=_dimensions)
    return agg.join(med, ["dim", "value"]).where((F.col("dim") != "path") | (F.col("n") >= min_path_n)
                                                 ).select("dim", "value", "n", "mean", "median", "hit_rate")


def directional_hit_rate(scored: DataFrame) -> DataFrame:
    """A gain call is right above zero, any other call below."""
    right = F.when(F.col("impact") == S.IMPACT_GAIN, F.col("forward_return") > 0).otherwise(
        F.col("forward_return") < 0)
    return scored.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("directional_hit_rate"))


def gap_validity(scored: DataFrame, min_rows: int = 5) -> DataFrame:
    """Does the gap predict? Correlation with the return, and the quarter with the largest gaps."""
    g = scored.where(F.col("gap").isNotNull())
    corr = g.agg(F.count("*").alias("n"), safe_corr(F.col("gap"), F.col("forward_return")).alias("corr"))
    top = largest(g, "gap", 4, ["base_date", "ticker", "idea", "name"])
    best = top.agg(F.count("*").alias("top_n"), F.avg("forward_return").alias("top_mean"),
                   F.avg((F.col("forward_return") > 0).cast("double")).alias("top_hit_rate"))
    # two one-row tables
    return corr.where(F.col("n") >= min_rows).join(F.broadcast(best))
