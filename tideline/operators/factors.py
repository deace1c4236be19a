"""Signed factor exposures and group gaps after removing the market.

Regressions are closed forms over sums. Missing returns enter as zeros (after an 80 % coverage
gate), so a ticker's missing days contribute nothing to any sum that involves it, and only observed
rows are ever joined. Sums of the market and of the factors alone are taken once per series and
carry the full window length. Everything is ``groupBy`` with map-side combine; the tables that
are broadcast hold one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions.numbers import corr_from_sums, ratio, safe_corr, variance_from_sums

CFG = S.HorizontalSettings()


def window_length(n_days: Column, wanted: int) -> Column:
    """Regression window cut to the history that exists, at least 20."""
    return F.greatest(F.lit(20), F.least(F.lit(wanted), n_days - 1))


def _beta(n, sx, sy, sxx, sxy) -> Column:
    return F.try_divide(sxy - sx * sy / n, variance_from_sums(n, sx, sxx))


def _corr(n, sx, sy, sxx, syy, sxy) -> Column:
    return corr_from_sums(n, sx, sy, sxx, syy, sxy)


def beta_corr(rets: DataFrame, series: DataFrame, min_ratio: float = CFG.min_valid_ratio
              ) -> DataFrame:
    """Single regressions of every ticker on one series over the days of ``series(dt_idx, x)``.

    (ticker, n, n_obs, beta, corr); tickers observed on less than ``min_ratio`` of the days and a
    series without variance give no row; a ticker without variance has a NULL correlation.
    """
    x0 = series.select("dt_idx", F.coalesce(F.col("x"), F.lit(0.0)).alias("x"))
    whole = x0.agg(F.count("*").alias("n"), F.sum("x").alias("sx"),
                   F.sum(F.col("x") * F.col("x")).alias("sxx"))
    per = (rets.where(F.col("ret").isNotNull()).join(F.broadcast(x0), "dt_idx")
           .groupBy("ticker").agg(
               F.count("*").alias("n_obs"), F.sum("ret").alias("sy"),
               F.sum(F.col("ret") * F.col("ret")).alias("syy"),
               F.sum(F.col("ret") * F.col("x")).alias("sxy")))
    c = F.col
    both = per.join(F.broadcast(whole), c("n_obs") >= c("n") * min_ratio)
    out = both.select(
        "ticker", "n", "n_obs", _beta(c("n"), c("sx"), c("sy"), c("sxx"), c("sxy")).alias("beta"),
        _corr(c("n"), c("sx"), c("sy"), c("sxx"), c("syy"), c("sxy")).alias("corr"))
    return out.where(F.col("beta").isNotNull())


def factor_returns(closes: DataFrame, cal: DataFrame) -> DataFrame:
    """(factor, dt_idx, age, n_days, f) on the panel's calendar; a missing day stays missing."""
    on_cal = closes.where(F.col("close") > 0).join(F.broadcast(cal), "base_date")
    w = Window.partitionBy("factor").orderBy("dt_idx")
    ret = F.when(F.lag("dt_idx").over(w) == F.col("dt_idx") - 1,
                 F.col("close") / F.lag("close").over(w) - 1)
    return (on_cal.select("factor", "dt_idx", "age", "n_days", ret.alias("f"))
            .where(F.col("f").isNotNull()))


def market_window(cal: DataFrame, market: DataFrame, wanted: int,
                  min_ratio: float = CFG.min_valid_ratio) -> DataFrame:
    """(dt_idx, age, w, m): market over the window, zero-filled; empty if it barely overlaps."""
    win = window_length(F.col("n_days"), wanted)
    days = cal.where(F.col("age") < win).select("dt_idx", "age", win.alias("w"))
    joined = days.join(F.broadcast(market.select("dt_idx", F.col("ret").alias("mr"))),
                       "dt_idx", "left")
    seen = F.count("mr").over(Window.partitionBy(F.lit(0)))
    return joined.withColumn("_seen", seen).where(F.col("_seen") >= F.col("w") * min_ratio).select(
        "dt_idx", "age", "w", F.coalesce(F.col("mr"), F.lit(0.0)).alias("m"))


def factor_residuals(factors: DataFrame, market: DataFrame,
                     min_ratio: float = CFG.min_valid_ratio) -> DataFrame:
    """(factor, dt_idx, m, e): factor return minus its market part, on the factor's own days."""
    own = factors.where(F.col("factor") != S.MARKET_FACTOR).join(F.broadcast(market), "dt_idx")
    c = F.col
    beta = own.groupBy("factor").agg(
        F.count("*").alias("n"), F.sum("m").alias("sm"), F.sum("f").alias("sf"),
        F.sum(c("m") * c("m")).alias("smm"), F.sum(c("m") * c("f")).alias("smf"),
        F.max("w").alias("w")).where(c("n") >= c("w") * min_ratio).select(
            "factor", _beta(c("n"), c("sm"), c("sf"), c("smm"), c("smf")).alias("fb")
        ).where(c("fb").isNotNull())
    # one row per configured factor
    return own.join(F.broadcast(beta), "factor").select(
        "factor", "dt_idx", "m", (c("f") - c("fb") * c("m")).alias("e"))


def market_betas(rets: DataFrame, market: DataFrame) -> DataFrame:
    return beta_corr(rets, market.select("dt_idx", F.col("m").alias("x"))).select(
        "ticker", F.col("beta").alias("bm"))


def exposures(rets: DataFrame, factors: DataFrame, market: DataFrame, betas: DataFrame,
              cfg: S.HorizontalSettings = CFG) -> DataFrame:
    """(ticker, factor, beta, corr) with |corr| at or above the limit, full precision.

    The residual of a ticker is y - bm*m with y zero-filled, so its sums over a factor's days
    follow from sums of y, y*m, y*e over observed rows plus per-factor sums of m and e.
    """
    resid = factor_residuals(factors, market, cfg.min_valid_ratio)
    c = F.col
    per_factor = resid.groupBy("factor").agg(
        F.count("*").alias("n"), F.sum("e").alias("se"), F.sum(c("e") * c("e")).alias("see"),
        F.sum("m").alias("sm"), F.sum(c("m") * c("m")).alias("smm"),
        F.sum(c("m") * c("e")).alias("sme"))
    sums = (rets.where(c("ret").isNotNull()).select("ticker", "dt_idx", c("ret").alias("y"))
            .join(F.broadcast(resid), "dt_idx").groupBy("ticker", "factor").agg(
                F.sum("y").alias("sy"), F.sum(c("y") * c("y")).alias("syy"),
                F.sum(c("y") * c("m")).alias("sym"), F.sum(c("y") * c("e")).alias("sye")))
    j = sums.join(betas, "ticker").join(F.broadcast(per_factor), "factor")
    sr = c("sy") - c("bm") * c("sm")
    srr = c("syy") - 2.0 * c("bm") * c("sym") + c("bm") * c("bm") * c("smm")
    sre = c("sye") - c("bm") * c("sme")
    out = j.select("ticker", "factor", _beta(c("n"), c("se"), sr, c("see"), sre).alias("beta"),
                   _corr(c("n"), c("se"), sr, c("see"), srr, sre).alias("corr"))
    return out.where(F.abs("corr") >= cfg.min_abs_corr)


def factor_moves(factors: DataFrame, market: DataFrame,
                 min_ratio: float = CFG.min_valid_ratio) -> DataFrame:
    """(factor, ret5, ret20): sums of the last 5 and 20 observed returns inside the window."""
    own = factors.where(F.col("factor") != S.MARKET_FACTOR).join(
        F.broadcast(market.select("dt_idx", "w")), "dt_idx")
    rn = F.row_number().over(Window.partitionBy("factor").orderBy(F.col("dt_idx").desc()))
    agg = own.withColumn("rn", rn).groupBy("factor").agg(
        F.count("*").alias("n"), F.max("w").alias("w"),
        F.sum(F.when(F.col("rn") <= 5, F.col("f"))).alias("ret5"),
        F.sum(F.when(F.col("rn") <= 20, F.col("f"))).alias("ret20"))
    return agg.where(F.col("n") >= F.col("w") * min_ratio).select("factor", "ret5", "ret20")


def group_history(group_ret: DataFrame, market: DataFrame, cal: DataFrame,
                  cfg: S.HorizontalSettings = CFG) -> DataFrame:
    """(grp, dt_idx, pos, w, m, g): the last ``w`` days on which a group has a return.

    ``pos`` counts back from the newest of those days; ``m`` is the zero-filled market.
    """
    win = window_length(F.col("n_days"), cfg.beta_window)
    pos = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("dt_idx").desc())) - 1
    mkt = cal.select("dt_idx").join(
        F.broadcast(market.select("dt_idx", F.col("ret").alias("mr"))), "dt_idx", "left")
    hist = (group_ret.where(F.col("ret").isNotNull()).withColumn("pos", pos)
            .withColumn("w", win).where(F.col("pos") < F.col("w"))
            .join(F.broadcast(mkt), "dt_idx"))
    n_hist = F.count("*").over(Window.partitionBy("grp"))
    return hist.withColumn("n_hist", n_hist).where(
        F.col("n_hist") >= F.col("w") * cfg.min_valid_ratio).select(
            "grp", "dt_idx", "pos", "n_hist", F.coalesce("mr", F.lit(0.0)).alias("m"),
            F.col("ret").alias("g"))


def group_moves(hist: DataFrame, cfg: S.HorizontalSettings = CFG) -> DataFrame:
    """Per group: market beta, own recent move, and sums needed by the member regressions."""
    c = F.col
    agg = hist.groupBy("grp").agg(
        F.max("n_hist").alias("n"), F.sum("m").alias("sm"), F.sum("g").alias("sg"),
        F.sum(c("m") * c("m")).alias("smm"), F.sum(c("m") * c("g")).alias("smg"),
        F.sum(c("g") * c("g")).alias("sgg"),
        F.sum(F.when(c("pos") < cfg.gap_window, c("m"))).alias("recent_m"),
        F.sum(F.when(c("pos") < cfg.gap_window, c("g"))).alias("recent_graw"))
    agg = agg.withColumn("gb", _beta(c("n"), c("sm"), c("sg"), c("smm"), c("smg"))).where(
        c("gb").isNotNull())
    return agg.select(
        "grp", "n", "gb", "recent_m", (c("recent_graw") - c("gb") * c("recent_m")).alias("recent_g"),
        "sm", "smm", (c("sg") - c("gb") * c("sm")).alias("se"),
        (c("sgg") - 2.0 * c("gb") * c("smg") + c("gb") * c("gb") * c("smm")).alias("see"),
        (c("smg") - c("gb") * c("smm")).alias("sme"))


def recent_actual(rets: DataFrame, cfg: S.HorizontalSettings = CFG) -> DataFrame:
    """(ticker, actual): sum over the panel's last days, for tickers that really traded."""
    need = max(1, int(cfg.gap_window * 0.6))
    return (rets.where(F.col("ret").isNotNull() & (F.col("age") < cfg.gap_window))
            .groupBy("ticker").agg(F.sum("ret").alias("actual"), F.count("ret").alias("n"))
            .where(F.col("n") >= need).select("ticker", "actual"))


def group_gaps(rets: DataFrame, members: DataFrame, group_ret: DataFrame, market: DataFrame,
               cal: DataFrame, cfg: S.HorizontalSettings = CFG) -> DataFrame:
    """(grp, group_move, ticker, beta, corr, expected, actual, gap), full precision.

    Groups without a move of their own are dropped before any member is regressed.
    """
    c = F.col
    in_panel = members.join(rets.select("ticker").distinct(), "ticker", "left_semi")
    sizes = in_panel.groupBy("grp").agg(F.count("*").alias("k")).where(
        c("k") >= cfg.min_group_members)
    hist = group_history(group_ret, market, cal, cfg)
    moves = group_moves(hist, cfg).where(F.abs("recent_g") >= cfg.min_group_move).join(
        sizes.select("grp"), "grp", "left_semi")
    live_hist = hist.join(moves.select("grp", "gb"), "grp").select(
        "grp", "dt_idx", "m", (c("g") - c("gb") * c("m")).alias("e"))
    pairs = in_panel.join(moves.select("grp"), "grp", "left_semi")
    y = rets.where(c("ret").isNotNull()).select("ticker", "dt_idx", c("ret").alias("y"))
    sums = (pairs.join(y, "ticker").join(live_hist, ["grp", "dt_idx"])
            .groupBy("grp", "ticker").agg(
                F.count("*").alias("n_obs"), F.sum("y").alias("sy"),
                F.sum(c("y") * c("y")).alias("syy"), F.sum(c("y") * c("m")).alias("sym"),
                F.sum(c("y") * c("e")).alias("sye")))
    j = sums.join(moves, "grp").where(c("n_obs") >= c("n") * cfg.min_valid_ratio).withColumn(
        "bm", _beta(c("n"), c("sm"), c("sy"), c("smm"), c("sym"))).where(c("bm").isNotNull())
    sr = c("sy") - c("bm") * c("sm")
    srr = c("syy") - 2.0 * c("bm") * c("sym") + c("bm") * c("bm") * c("smm")
    sre = c("sye") - c("bm") * c("sme")
    fitted = j.withColumn("beta", _beta(c("n"), c("se"), sr, c("see"), sre)).withColumn(
        "corr", _corr(c("n"), c("se"), sr, c("see"), srr, sre)).where(
            c("corr") >= cfg.min_group_corr)
    expected = c("bm") * c("recent_m") + c("beta") * c("recent_g")
    return fitted.join(recent_actual(rets, cfg), "ticker").select(
        "grp", c("recent_g").alias("group_move"), "ticker", "beta", "corr",
        expected.alias("expected"), "actual", (expected - c("actual")).alias("gap"))


def gap_market(rets: DataFrame, market: DataFrame | None, cal: DataFrame,
               min_ratio: float = CFG.min_valid_ratio) -> DataFrame:
    """The given market series, or the universe mean when it barely overlaps the panel."""
    mean = rets.groupBy("dt_idx").agg(F.avg("ret").alias("mean_ret"))
    if market is None:
        return mean.select("dt_idx", F.col("mean_ret").alias("ret"))
    both = (cal.select("dt_idx", "n_days").join(F.broadcast(market), "dt_idx", "left")
            .join(F.broadcast(mean), "dt_idx", "left"))
    seen = F.count("ret").over(Window.partitionBy(F.lit(0)))
    return both.withColumn("_ok", seen >= F.col("n_days") * min_ratio).select(
        "dt_idx", F.when(F.col("_ok"), F.col("ret")).otherwise(F.col("mean_ret")).alias("ret"))


def report_gaps(gaps: DataFrame) -> DataFrame:
    """Published precision of the gap table."""
    return gaps.select("grp", F.round("group_move", 4).alias("group_move"), "ticker",
                       F.round("beta", 2).alias("beta"), F.round("corr", 2).alias("corr"),
                       F.round("expected", 4).alias("expected"),
                       F.round("actual", 4).alias("actual"), F.round("gap", 4).alias("gap"))


def best_gap(gaps: DataFrame) -> DataFrame:
    """The group in which a ticker lags most; ties go to the first group by name."""
    cols = ("grp", "group_move", "beta", "corr", "expected", "actual", "gap")
    best = gaps.groupBy("ticker").agg(
        F.min_by(F.struct(*cols), F.struct((-F.col("gap")).alias("k"), "grp")).alias("b"))
    return best.select("ticker", *[F.col(f"b.{x}").alias(x) for x in cols])


def group_peers(gaps: DataFrame, tickers: DataFrame, cfg: S.HorizontalSettings = CFG) -> DataFrame:
    """For each ticker asked about: the other members of its groups with the largest gaps.

    Only the best ``max_peers + 1`` members of a group can appear, so groups are cut to those first
    and the ticker itself is removed afterwards.
    """
    by_gap = Window.partitionBy("grp").orderBy(F.col("gap").desc(), "ticker")
    top = gaps.withColumn("rn", F.row_number().over(by_gap)).where(
        F.col("rn") <= cfg.max_peers + 1)
    mine = tickers.select(F.col("ticker").alias("of")).join(
        gaps.select(F.col("ticker").alias("of"), F.col("grp").alias("g")), "of")
    others = mine.join(top, F.col("g") == F.col("grp")).where(F.col("ticker") != F.col("of"))
    rn = F.row_number().over(Window.partitionBy("of", "grp").orderBy(F.col("gap").desc(), "ticker"))
    return others.withColumn("rank", rn).where(F.col("rank") <= cfg.max_peers).select(
        "of", "grp", "rank", "ticker", "gap", (F.col("gap") > cfg.unreacted_gap).alias("unreacted"))


def top_groups(gaps: DataFrame, n_groups: int = 8, n_members: int = 6) -> DataFrame:
    """Groups that moved most, and in each the members that lag most."""
    moved = gaps.groupBy("grp").agg(F.max("group_move").alias("mv")).orderBy(
        F.abs("mv").desc(), "grp").limit(n_groups)
    by_gap = Window.partitionBy("grp").orderBy(F.col("gap").desc(), "ticker")
    return gaps.join(moved.select("grp"), "grp", "left_semi").withColumn(
        "rank", F.row_number().over(by_gap)).where(F.col("rank") <= n_members)


def ranked_exposures(exp: DataFrame, moves: DataFrame) -> DataFrame:
    """A ticker's exposures by |corr|, with the factor's 5-day move."""
    w = Window.partitionBy("ticker").orderBy(F.abs("corr").desc(), "factor")
    return exp.withColumn("rank", F.row_number().over(w)).join(
        F.broadcast(moves.select("factor", "ret5")), "factor", "left")
