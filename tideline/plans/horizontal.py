"""Queries: groups, factor exposures, group gaps (supplier months; part types as factors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import factors as X
from tideline.operators import groups as G
from tideline.operators import market as M
from tideline.operators import signals as sig
from tideline.plans import inputs as I
from tideline.plans.registry import query, rounded
from tideline.plans.shared import kept
from tideline.sources import panel as P

# Supplier prices are noisier than listed prices, so weaker ties count in these demonstrations.
CFG = S.HorizontalSettings(min_abs_corr=0.1, min_group_corr=0.3)


@kept
def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.with_daily_return(I.supplier_panel(spark, sf_dir)).select(
        "ticker", "dt_idx", "age", "n_days", "ret")


@kept
def cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.calendar(I.supplier_cells(spark, sf_dir))


@kept
def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.market_return(returns(spark, sf_dir), I.supplier_caps(spark, sf_dir))


@kept
def market_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.market_window(cal(spark, sf_dir), market(spark, sf_dir), CFG.beta_window)


@kept
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as groups of suppliers."""
    m = I.supplier_master(spark, sf_dir)
    nation = m.select(F.concat(F.lit(S.INDUSTRY_GROUP_PREFIX), "sector").alias("grp"), "ticker")
    region = m.select(F.concat(F.lit(S.THEME_GROUP_PREFIX), "market").alias("grp"), "ticker")
    return G.union_groups(nation, region, universe=m.where("market_cap is not null"))


@kept
def group_rets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_returns(returns(spark, sf_dir), groups(spark, sf_dir))


@kept
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets, mkt = returns(spark, sf_dir), market_win(spark, sf_dir)
    f = X.factor_returns(I.factor_cells(spark, sf_dir), cal(spark, sf_dir))
    return X.exposures(rets, f, mkt, X.market_betas(rets, mkt), CFG)


@kept
def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.factor_returns(I.factor_cells(spark, sf_dir), cal(spark, sf_dir))
    return X.factor_moves(f, market_win(spark, sf_dir))


@kept
def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets, days = returns(spark, sf_dir), cal(spark, sf_dir)
    mkt = X.gap_market(rets, market(spark, sf_dir), days)
    return X.group_gaps(rets, groups(spark, sf_dir), group_rets(spark, sf_dir), mkt, days, CFG)


@query("a2_group_return")
def a2(spark, sf_dir):
    return rounded(group_rets(spark, sf_dir), 8, "ret").select("grp", "dt_idx", "ret", "n_obs")


@query("a3_industry_return")
def a3(spark, sf_dir):
    out = G.industry_returns(returns(spark, sf_dir), I.supplier_members(spark, sf_dir),
                             I.supplier_caps(spark, sf_dir))
    return rounded(out, 8, "ret").select("industry", "dt_idx", "ret", "n_obs")


@query("a4_beta_corr")
def a4(spark, sf_dir):
    series = market(spark, sf_dir).where("ret is not null").select(
        "dt_idx", F.col("ret").alias("x"))
    return rounded(X.beta_corr(returns(spark, sf_dir), series), 7, "beta", "corr")


@query("a5_factor_exposure")
def a5(spark, sf_dir):
    return rounded(exposures(spark, sf_dir), 6, "beta", "corr")


@query("a5_market_beta")
def a5_beta(spark, sf_dir):
    b = X.market_betas(returns(spark, sf_dir), market_win(spark, sf_dir))
    return b.select("ticker", F.round("bm", 6).alias("market_beta"))


@query("a6_factor_move")
def a6(spark, sf_dir):
    return rounded(moves(spark, sf_dir), 8, "ret5", "ret20")


@query("a7_group_gap")
def a7(spark, sf_dir):
    return rounded(gaps(spark, sf_dir), 6, "group_move", "beta", "corr", "expected", "actual", "gap")


@query("a12_best_gap")
def a12(spark, sf_dir):
    return rounded(X.best_gap(gaps(spark, sf_dir)), 6, "group_move", "beta", "corr", "expected",
                   "actual", "gap")


@query("t3_group_peers")
def t3(spark, sf_dir):
    g = gaps(spark, sf_dir)
    return rounded(X.group_peers(g, g.select("ticker").distinct(), CFG), 6, "gap")


@query("t4_top_groups")
def t4(spark, sf_dir):
    return rounded(X.top_groups(gaps(spark, sf_dir)), 6, "group_move", "gap").select(
        "grp", "group_move", "rank", "ticker", "gap")


@query("t9_factor_rank")
def t9(spark, sf_dir):
    out = X.ranked_exposures(exposures(spark, sf_dir), moves(spark, sf_dir))
    return rounded(out, 6, "corr", "ret5").select("ticker", "rank", "factor", "corr", "ret5")


@query("j2_align_dates")
def j2(spark, sf_dir):
    """Days shared by the market series and each factor."""
    f = X.factor_returns(I.factor_cells(spark, sf_dir), cal(spark, sf_dir))
    m = market(spark, sf_dir).where("ret is not null").select("dt_idx")
    return f.join(F.broadcast(m), "dt_idx").groupBy("factor").agg(
        F.count("*").alias("n_common"), F.min("dt_idx").alias("first"), F.max("dt_idx").alias("last"))


@query("j3_reindex")
def j3(spark, sf_dir):
    """Every group series on the whole calendar, missing days NULL."""
    g = group_rets(spark, sf_dir)
    # one row: the length of the calendar
    last = cal(spark, sf_dir).agg(F.max("dt_idx").alias("last"))
    days = g.select("grp").distinct().join(F.broadcast(last)).select("grp", F.explode(F.sequence(F.lit(0), "last")).alias("dt_idx"))
    return days.join(g.select("grp", "dt_idx", F.round("ret", 8).alias("ret")), ["grp", "dt_idx"], "left")


@query("u2_group_union")
def u2(spark, sf_dir):
    return groups(spark, sf_dir)


@query("a28_inverse_membership")
def a28(spark, sf_dir):
    inv = G.inverse_membership(groups(spark, sf_dir))
    return inv.select("ticker", F.array_join("groups", "|").alias("groups"))
