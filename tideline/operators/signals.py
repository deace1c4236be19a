"""Screening signals.

Every end-of-panel signal is a conditional aggregate over the age of the day, so the whole signal
table is one map-side combined ``groupBy(ticker)``: no per-ticker sort, no dense grid. The series
versions (moving averages over time, daily returns) use RANGE frames over ``dt_idx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions.numbers import ratio
from tideline.operators.order_stats import with_pct_rank

def with_daily_return(panel: DataFrame) -> DataFrame:
    """close / previous calendar day's close - 1; NULL when either day is missing."""
    w = Window.partitionBy("ticker").orderBy("dt_idx")
    prev_close, prev_idx = F.lag("close").over(w), F.lag("dt_idx").over(w)
    return panel.withColumn(
        "ret", F.when(prev_idx == F.col("dt_idx") - 1, ratio(F.col("close"), prev_close) - 1.0))


def with_moving_averages(panel: DataFrame, lengths: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Means over the last n calendar rows, NULL unless all n are observed."""
    by_day = Window.partitionBy("ticker").orderBy("dt_idx")
    out = panel
    for n in lengths:
        w = by_day.rangeBetween(-(n - 1), 0)
        out = out.withColumn(f"ma{n}", F.when(F.count("close").over(w) == n,
                                              F.avg("close").over(w)))
    return out


def _at(age: int) -> Column:
    return F.max(F.when(F.col("age") == age, F.col("close")))


def _mean(col: str, newest: int, oldest: int) -> Column:
    return F.avg(F.when(F.col("age").between(newest, oldest), F.col(col)))


def _full_mean(age: int, length: int) -> Column:
    inside = F.when(F.col("age").between(age, age + length - 1), F.col("close"))
    return F.when(F.count(inside) == length, F.avg(inside))


def compute_signals(panel: DataFrame, cfg: S.ScreenSettings | None = None) -> DataFrame:
    """One row per ticker that has a 20-day return and a 120-day high today."""
    cfg = cfg or S.ScreenSettings()
    gc = cfg.golden_cross_window
    enough = F.when(F.max("n_days") <= 20, F.raise_error(F.lit(
        "a 20-day return needs at least 21 trading days; raise lookback_days"))
        .cast("boolean")).otherwise(F.lit(True))
    wide = panel.groupBy("ticker").agg(
        F.count("close").alias("n_obs"), enough.alias("_enough"),
        _at(0).alias("close"), _at(5).alias("c5"), _at(20).alias("c20"), _at(60).alias("c60"),
        _full_mean(0, 20).alias("ma20"), _full_mean(0, 60).alias("ma60"),
        _full_mean(gc, 20).alias("ma20_then"), _full_mean(gc, 60).alias("ma60_then"),
        _full_mean(10, 60).alias("ma60_10"), _full_mean(30, 60).alias("ma60_30"),
        _full_mean(40, 60).alias("ma60_40"),
        _mean("volume", 0, 4).alias("vol_recent"), _mean("volume", 5, 24).alias("vol_base"),
        F.max(F.when(F.col("age") <= 119, F.col("close"))).alias("high120"),
        # a mean of up to 20 amounts in cents: rounded, it no longer depends on the order of summation
        F.round(_mean("value", 0, 19), 6).alias("avg_turnover"))
    above_now = F.coalesce(F.col("ma20") > F.col("ma60"), F.lit(False))
    above_then = F.coalesce(F.col("ma20_then") > F.col("ma60_then"), F.lit(False))
    turning = ((F.col("ma60") - F.col("ma60_10") > 0)
               & (F.col("ma60_30") - F.col("ma60_40") < 0))
    c = F.col("close")
    sig = wide.where(F.col("_enough") & (F.col("n_obs") >= cfg.min_history)).select(
        "ticker", "n_obs", "close",
        (ratio(c, F.col("c5")) - 1).alias("ret5"), (ratio(c, F.col("c20")) - 1).alias("ret20"),
        (ratio(c, F.col("c60")) - 1).alias("ret60"),
        (above_now & ~above_then).alias("golden_cross"),
        F.coalesce(turning, F.lit(False)).alias("slope_turn"),
        ratio(F.col("vol_recent"), F.col("vol_base")).alias("vol_surge"),
        ratio(c, F.col("high120")).alias("high_proximity"), "avg_turnover")
    return sig.where(F.col("ret20").isNotNull() & F.col("high_proximity").isNotNull())


def with_caps(signals: DataFrame, master: DataFrame) -> DataFrame:
    caps = master.where(F.col("market_cap").isNotNull()).select("ticker", "name", "market_cap")
    return signals.join(caps, "ticker", "inner")


def require_caps(master: DataFrame) -> None:
    """A cap column that is missing everywhere stops the run instead of skipping the filter."""
    if master.where(F.col("market_cap").isNotNull()).limit(1).count() == 0:
        raise ValueError("no market cap on the base date: the size filter cannot be applied")


def filter_universe(signals: DataFrame, cfg: S.ScreenSettings) -> DataFrame:
    return signals.where((F.col("market_cap") >= cfg.min_market_cap)
                         & (F.col("avg_turnover") >= cfg.min_avg_turnover))


def with_trigger(signals: DataFrame, cfg: S.ScreenSettings) -> DataFrame:
    """Tag the reason a ticker qualifies; momentum wins over turnaround, NULL means neither."""
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    momentum = (yes(F.col("ret20") >= cfg.momentum_ret20)
                | yes(F.col("high_proximity") >= cfg.high_proximity))
    turnaround = ((F.col("golden_cross") | F.col("slope_turn"))
                  & yes(F.col("vol_surge") >= cfg.volume_surge_ratio))
    return signals.withColumn("trigger", F.when(momentum, S.TRIGGER_MOMENTUM)
                              .when(turnaround, S.TRIGGER_TURNAROUND))


def with_score(cands: DataFrame) -> DataFrame:
    """Sum of the percentile ranks of 20-day return, volume surge and closeness to the high."""
    ranked = cands
    for col, out in (("ret20", "rank_ret"), ("vol_surge", "rank_vol"),
                     ("high_proximity", "rank_high")):
        ranked = with_pct_rank(ranked, col, out)
    return ranked.withColumn("score", F.col("rank_ret") + F.col("rank_vol") + F.col("rank_high"))


def screen(panel: DataFrame, master: DataFrame,
           cfg: S.ScreenSettings | None = None) -> tuple[DataFrame, DataFrame]:
    """(top candidates with their place ``pos``, filtered universe)."""
    cfg = cfg or S.ScreenSettings()
    universe = filter_universe(with_caps(compute_signals(panel, cfg), master), cfg)
    cands = with_score(with_trigger(universe, cfg).where(F.col("trigger").isNotNull()))
    order = [F.col("score").desc_nulls_last(), F.col("ticker")]
    # the window sees the rows of the limit only
    top = (cands.orderBy(*order).limit(cfg.top_n).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
           .select("ticker", "name", "trigger", F.floor("close").cast("long").alias("close"),
                   F.round("ret5", 4).alias("ret5"), F.round("ret20", 4).alias("ret20"),
                   F.round("ret60", 4).alias("ret60"), F.round("vol_surge", 2).alias("vol_surge"),
                   F.round("high_proximity", 3).alias("high_proximity"), "market_cap", "pos"))
    return top, universe
