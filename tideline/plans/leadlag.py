"""Queries: lead/lag of related industries.

Short axis: nations (supplier months) along the flow relation. Slow axis: part type x size band,
priced daily by brand, along relations between bands of one type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import nodes as N
from tideline.functions.numbers import corr_t, corr_threshold
from tideline.operators import graph as R
from tideline.operators import groups as G
from tideline.operators import leadlag as L
from tideline.operators import market as M
from tideline.operators import signals as sig
from tideline.plans import horizontal as H
from tideline.plans import inputs as I
from tideline.plans import relations as Q
from tideline.plans.registry import query, rounded
from tideline.plans.shared import kept
from tideline.sources import panel as P


@kept
def nation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual nation returns (name, dt_idx, ret)."""
    raw = G.industry_returns(H.returns(spark, sf_dir), I.supplier_members(spark, sf_dir),
                             I.supplier_caps(spark, sf_dir)).select(
        F.col("industry").alias("name"), "dt_idx", "ret")
    return L.residualize(raw, H.market(spark, sf_dir), H.cal(spark, sf_dir))


@kept
def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow relations plus memberships, as the graph stores them."""
    return R.merge(Q.map_edges(spark, sf_dir))


@kept
def band_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(industry, ticker): part type x size band, brands that sell there above their par."""
    t = I.brand_trades(spark, sf_dir).select(
        "ticker", F.concat_ws(" ", "p_type", F.col("band").cast("string")).alias("industry"), "cents")
    rev = t.groupBy("ticker", "industry").agg(F.sum("cents").alias("rev"))
    par = rev.groupBy("ticker").agg(F.sum("rev").alias("total"), F.count("*").alias("n"))
    return rev.join(par, "ticker").where(F.col("rev") * F.col("n") >= F.col("total")).select(
        "industry", "ticker")


@kept
def brand_day_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sig.with_daily_return(I.brand_day_panel(spark, sf_dir)).select(
        "ticker", "dt_idx", "age", "n_days", "ret")


@kept
def band_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rets, caps = brand_day_returns(spark, sf_dir), I.brand_master(spark, sf_dir)
    raw = G.industry_returns(rets, band_members(spark, sf_dir), caps).select(
        F.col("industry").alias("name"), "dt_idx", "ret")
    return L.residualize(raw, M.market_return(rets, caps), P.calendar(I.brand_day_cells(spark, sf_dir)))


@kept
def band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of one part type feed each other, smaller into larger; both directions stored."""
    bands = band_members(spark, sf_dir).select("industry").distinct().withColumn(
        "kind", F.substring_index("industry", " ", 1)).withColumn(
        "band", F.substring_index("industry", " ", -1).cast("int"))
    nxt = bands.select("kind", F.col("industry").alias("to"), F.explode(
        F.array(F.col("band") - 1, F.col("band") - 2)).alias("band"))
    e = bands.join(nxt, ["kind", "band"])
    fwd = R.edges(e, src=N.industry_node(F.col("industry")), dst=N.industry_node(F.col("to")),
                  rel=S.REL_DOWNSTREAM, source="valuechain", asof=Q.ASOF)
    back = R.edges(e, src=N.industry_node(F.col("to")), dst=N.industry_node(F.col("industry")),
                   rel=S.REL_UPSTREAM, source="valuechain", asof=Q.ASOF)
    return R.merge(fwd, back)


@kept
def cycle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cycle_lags(band_edges(spark, sf_dir), band_series(spark, sf_dir),
                        band_members(spark, sf_dir))


@kept
def nation_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag profile of every related pair of nations; what lags are asked for reads it."""
    pairs = L.once_per_pair(L.industry_pairs(nation_edges(spark, sf_dir)))
    return L.pair_profiles(pairs, L.pack(nation_series(spark, sf_dir)), 20)


@kept
def scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_price_lags(nation_edges(spark, sf_dir), L.best_lags(nation_profiles(spark, sf_dir)))


@kept
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.discover(nation_series(spark, sf_dir), nation_edges(spark, sf_dir), block_size=8)


@query("a8_residualize")
def a8(spark, sf_dir):
    return rounded(nation_series(spark, sf_dir), 8, "ret")


@query("a9_lag_corr")
def a9(spark, sf_dir):
    rows = nation_profiles(spark, sf_dir).select("a", "b", F.explode("profile").alias("p")).where("p.n >= 60")
    return rows.select("a", "b", "p.lag", "p.n", F.round("p.corr", 7).alias("corr"))


@query("j8_lagged_self_join")
def j8(spark, sf_dir):
    """Joint observations and correlation per pair and lag, wherever both series are there at once."""
    rows = nation_profiles(spark, sf_dir).select("a", "b", F.explode("profile").alias("p")).where("p.n > 0")
    return rows.select("a", "b", "p.lag", "p.n", F.round("p.corr", 7).alias("corr"))


@query("w10_best_lag")
def w10(spark, sf_dir):
    return rounded(L.best_lags(nation_profiles(spark, sf_dir)), 7, "corr")


@query("c18_corr_t")
def c18(spark, sf_dir):
    e = scored_edges(spark, sf_dir).where("price_corr is not null")
    return e.select("src", "dst", F.round(corr_t(F.col("price_corr"), F.col("price_obs")), 7).alias("t"))


@query("c19_corr_threshold")
def c19(spark, sf_dir):
    """Threshold for every sample size that occurs, at the number of measured pairs."""
    e = scored_edges(spark, sf_dir).where("price_obs is not null")
    n_pairs = e.agg(F.count("*").alias("k"))
    return e.select("price_obs").distinct().join(F.broadcast(n_pairs)).select(
        "price_obs", F.round(corr_threshold(F.col("price_obs"), F.col("k")), 9).alias("threshold"))


@query("g12_edge_price_score")
def g12(spark, sf_dir):
    return scored_edges(spark, sf_dir).select("src", "dst", "rel", "price_corr", "price_lag", "price_obs")


@query("f5_weak_edge_queue")
def f5(spark, sf_dir):
    return L.review_queue(scored_edges(spark, sf_dir), weak=0.3)


@query("j9_unlinked_pairs")
def j9(spark, sf_dir):
    return rounded(found(spark, sf_dir), 6, "corr")


@query("t7_discovery_topn")
def t7(spark, sf_dir):
    return rounded(L.discovery_top(found(spark, sf_dir)), 3, "corr")


@query("a10_monthly_blocks")
def a10(spark, sf_dir):
    return rounded(L.to_blocks(band_series(spark, sf_dir)), 8, "ret").withColumnRenamed("dt_idx", "pos")


@query("a11_member_jaccard")
def a11(spark, sf_dir):
    pairs = L.once_per_pair(L.industry_pairs(band_edges(spark, sf_dir)))
    return rounded(L.member_overlap(pairs, band_members(spark, sf_dir)), 9, "overlap")


@query("g13_cycle_lags")
def g13(spark, sf_dir):
    return rounded(rounded(cycle_table(spark, sf_dir), 6, "corr"), 4, "overlap")


@query("u5_pair_dedupe")
def u5(spark, sf_dir):
    """Each unordered pair once, and its mirror with the opposite lag."""
    both = L.measured_both_ways(L.best_lags(nation_profiles(spark, sf_dir)))
    return both.select("a", "b", "lag", "n", "mirrored")


@query("j14_cycle_lag_attach")
def j14(spark, sf_dir):
    return L.attach_cycle_lags(band_edges(spark, sf_dir), cycle_table(spark, sf_dir)).select(
        "src", "dst", "rel", "cycle_lag_months", "cycle_corr")


@query("t8_lag_table_topn")
def t8(spark, sf_dir):
    return rounded(L.lag_table_top(cycle_table(spark, sf_dir)), 6, "corr").select("a", "b", "lag", "corr", "n")
