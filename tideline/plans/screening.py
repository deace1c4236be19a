"""Queries: ingest rules, panels, signals, the screen."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import groups as G
from tideline.operators import market as M
from tideline.operators import signals as sig
from tideline.operators.order_stats import with_pct_rank
from tideline.plans import inputs as I
from tideline.plans.registry import query, rounded
from tideline.plans.shared import kept
from tideline.runtime import shared_folder
from tideline.sources import panel as P
from tideline.sources.records import save_by_date

# Revenue in cents stands in for market cap, so the size limits are those of this market.
SCREEN = S.ScreenSettings(min_market_cap=1_000_000_000, min_avg_turnover=10_000)

FACTOR_SPECS = [
    ("rings", ["small ring", "ring"], ["red", "old"]),
    ("gears", ["gear"], ["hot"]),
    ("rods", ["cold rod", "new rod", "rod"], []),
    ("silk", ["silk"], []),
    ("widgets", ["widget", "gizmo"], ["small", "large"]),
]


def factor_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        FACTOR_SPECS, "factor string, keywords array<string>, exclude array<string>")


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer codes in the four shapes a feed may use."""
    c = I.table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    seg = F.col("c_mktsegment")
    raw = (F.when(seg == "MACHINERY", F.concat(F.lit("kr7"), F.lpad(key, 6, "0"), F.lit("003")))
           .when(seg == "BUILDING", F.concat(F.lit("  "), key, F.lit(" ")))
           .when(seg == "AUTOMOBILE", F.concat(F.lit("0"), F.lpad(key, 4, "0"), F.lit("k")))
           .when(seg == "FURNITURE", F.concat(F.lit("xx"), key))
           .otherwise(key))
    return c.select("c_custkey", raw.alias("raw"))


@kept
def etf_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as listed products: monthly unit price per name."""
    li = I.table(spark, sf_dir, "lineitem")
    part = I.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.trunc("l_shipdate", "MM").alias("base_date"),
                    F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("ticker"),
                    F.col("p_name").alias("name"), I.cents("l_extendedprice").alias("cents"),
                    F.col("l_quantity").alias("qty")))
    return I._cells(rows, "base_date", "ticker", "name")


@query("s1_snapshot_scan")
def s1(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem")
    rows = li.select(F.to_date("l_shipdate").alias("base_date"),
                     I.supplier_ticker("l_suppkey").alias("ticker"), "l_orderkey",
                     "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
                     F.col("l_linestatus").alias("market"))
    first = P.first_per_ticker(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                      "l_extendedprice"])
    return first.select("base_date", "ticker", "market", "l_orderkey", "l_extendedprice")


@query("s2_resolve_fields")
def s2(spark, sf_dir):
    got = P.resolve_fields(I.table(spark, sf_dir, "lineitem"), {
        "ticker": ["ISU_SRT_CD", "l_suppkey"], "close": ["TDD_CLSPRC", "l_extendedprice"],
        "volume": ["l_quantity", "ACC_TRDVOL"], "name": ["ISU_NM"]}, optional=("name",))
    return got.groupBy("ticker").agg(F.count("close").alias("n"), F.max("close").alias("high"),
                                     F.sum("volume").alias("volume"))


@query("s3_numeric_cast")
def s3(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem")
    text = (F.when(F.col("l_returnflag") == "A", F.lit(" - "))
            .otherwise(F.concat(F.lit(" "), F.format_number("l_extendedprice", 2), F.lit(" "))))
    raw = li.select("l_returnflag", "l_linestatus", text.alias("price"))
    typed = P.cast_numeric(raw, text_fields=("l_returnflag", "l_linestatus"))
    return typed.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_rows"), F.count("price").alias("n_numbers"),
        F.max("price").alias("max_price"),
        F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"))


@query("s4_normalize_ticker")
def s4(spark, sf_dir):
    return raw_codes(spark, sf_dir).select(
        "c_custkey", "raw", P.normalize_ticker(F.col("raw")).alias("ticker"))


@query("s5_ticker_quality_gate")
def s5(spark, sf_dir):
    return P.code_quality(raw_codes(spark, sf_dir), "raw")


@query("s5_ticker_rejects")
def s5_rejects(spark, sf_dir):
    return raw_codes(spark, sf_dir).where(~P.looks_like_code(F.col("raw")))


@query("s6_price_panel")
def s6(spark, sf_dir):
    return rounded(I.supplier_panel(spark, sf_dir, 60), 6, "close", "value").select(
        "ticker", "base_date", "dt_idx", "age", "n_days", "close", "volume", "value")


@query("s7_etf_panel")
def s7(spark, sf_dir):
    cal = P.calendar(I.supplier_cells(spark, sf_dir), 24)
    panel, catalog = P.basket_panel(etf_cells(spark, sf_dir), cal)
    per = panel.groupBy("ticker").agg(F.count("close").alias("n_closes"),
                                      F.max("close").alias("high"))
    return rounded(per.join(catalog, "ticker", "left"), 6, "high").select(
        "ticker", "name", "n_closes", "high")


@query("s8_master_from_snapshot")
def s8(spark, sf_dir):
    cells = I.supplier_cells(spark, sf_dir)
    snap = cells.join(I.supplier_master(spark, sf_dir), "ticker")
    return P.master_from_snapshot(snap)


@query("s9_factor_proxy")
def s9(spark, sf_dir):
    cal = P.calendar(I.supplier_cells(spark, sf_dir), 24)
    panel, catalog = P.basket_panel(etf_cells(spark, sf_dir), cal)
    return P.factor_proxies(factor_specs(spark), catalog, panel)


def group_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed groups: nations as themes, part names as baskets of brands."""
    themes = I.supplier_members(spark, sf_dir).select(
        F.lit("theme").alias("kind"), F.col("industry").alias("name"), "ticker")
    part = I.table(spark, sf_dir, "part")
    renamed = F.replace(F.replace(F.col("p_name"), F.lit("red"), F.lit("미국")),
                        F.lit("gear"), F.lit("s&p gear"))
    baskets = part.select(F.lit("basket").alias("kind"), renamed.alias("name"),
                          F.when(F.col("p_size") == 1, F.col("p_brand"))
                          .otherwise(I.brand_ticker()).alias("ticker"))
    return themes.unionByName(baskets)


@query("s10_group_catalog")
def s10(spark, sf_dir):
    return G.group_catalog(group_listing(spark, sf_dir))


@query("s15_partition_sink")
def s15(spark, sf_dir):
    """Write a panel by date, restate its newest three dates, and read everything back."""
    panel = I.supplier_panel(spark, sf_dir).select("base_date", "ticker", "age", "volume")
    path = f"{shared_folder(spark)}/tideline-{spark.sparkContext.applicationId}/sink-{uuid.uuid4().hex}"
    save_by_date(panel, path)
    save_by_date(panel.where("age < 3").withColumn("volume", -F.col("volume")), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("base_date").cast("string").alias("base_date")).agg(
        F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("w1_daily_return")
def w1(spark, sf_dir):
    return rounded(sig.with_daily_return(I.brand_week_panel(spark, sf_dir)), 8, "ret").select(
        "ticker", "dt_idx", "ret")


@query("w2_period_return")
def w2(spark, sf_dir):
    s = sig.compute_signals(I.brand_week_panel(spark, sf_dir), SCREEN)
    return rounded(s, 8, "ret5", "ret20", "ret60").select("ticker", "ret5", "ret20", "ret60")


@query("w3_moving_avg")
def w3(spark, sf_dir):
    ma = sig.with_moving_averages(I.supplier_panel(spark, sf_dir))
    return rounded(ma, 6, "ma20", "ma60").select("ticker", "dt_idx", "ma20", "ma60")


@query("w4_golden_cross")
def w4(spark, sf_dir):
    s = sig.compute_signals(I.brand_week_panel(spark, sf_dir), SCREEN)
    return s.select("ticker", "golden_cross")


@query("w5_slope_turn")
def w5(spark, sf_dir):
    s = sig.compute_signals(I.brand_week_panel(spark, sf_dir), SCREEN)
    return s.select("ticker", "slope_turn")


@query("w6_volume_surge")
def w6(spark, sf_dir):
    s = sig.compute_signals(I.supplier_panel(spark, sf_dir), SCREEN)
    return rounded(s, 8, "vol_surge").select("ticker", "vol_surge")


@query("w7_high_proximity")
def w7(spark, sf_dir):
    s = sig.compute_signals(I.supplier_panel(spark, sf_dir), SCREEN)
    return rounded(rounded(s, 8, "high_proximity"), 4, "avg_turnover").select(
        "ticker", "high_proximity", "avg_turnover")


@query("w9_pct_rank_avg")
def w9(spark, sf_dir):
    c = I.table(spark, sf_dir, "part").select("p_partkey", F.when(
        F.col("p_type") != "PROMO", F.col("p_size")).alias("size"))
    return rounded(with_pct_rank(c, "size", "pct"), 9, "pct").select(
        "p_partkey", "size", "pct")


@query("f1_min_history")
def f1(spark, sf_dir):
    panel = I.brand_day_panel(spark, sf_dir, 130)
    return panel.groupBy("ticker").agg(F.count("close").alias("n_obs")).where("n_obs >= 60")


@query("f2_universe_filter")
def f2(spark, sf_dir):
    s = sig.with_caps(sig.compute_signals(I.supplier_panel(spark, sf_dir), SCREEN),
                      I.supplier_master(spark, sf_dir))
    return rounded(sig.filter_universe(s, SCREEN), 4, "avg_turnover").select(
        "ticker", "market_cap", "avg_turnover")


@query("f3_trigger_case")
def f3(spark, sf_dir):
    s = sig.compute_signals(I.supplier_panel(spark, sf_dir), SCREEN)
    return sig.with_trigger(s, SCREEN).where(F.col("trigger").isNotNull()).select(
        "ticker", "trigger")


@query("j1_signals_with_caps")
def j1(spark, sf_dir):
    s = sig.with_caps(sig.compute_signals(I.supplier_panel(spark, sf_dir), SCREEN),
                      I.supplier_master(spark, sf_dir))
    return rounded(s, 8, "ret20").select("ticker", "name", "market_cap", "ret20")


@query("t1_screen_topn")
def t1(spark, sf_dir):
    top, _ = sig.screen(I.brand_week_panel(spark, sf_dir), I.brand_master(spark, sf_dir), SCREEN)
    return top.drop("pos")


@query("t1_screen_suppliers")
def t1_suppliers(spark, sf_dir):
    top, _ = sig.screen(I.supplier_panel(spark, sf_dir), I.supplier_master(spark, sf_dir), SCREEN)
    return top.drop("pos")


@query("t2_universe_by_cap")
def t2(spark, sf_dir):
    _, universe = sig.screen(I.supplier_panel(spark, sf_dir), I.supplier_master(spark, sf_dir),
                             SCREEN)
    return universe.orderBy(F.col("market_cap").desc(), "ticker").select(
        "ticker", "name", "market_cap", F.floor("avg_turnover").cast("long")
        .alias("avg_turnover"))


@query("a1_market_return")
def a1(spark, sf_dir):
    rets = sig.with_daily_return(I.supplier_panel(spark, sf_dir))
    return rounded(M.market_return(rets, I.supplier_caps(spark, sf_dir)), 8, "ret").select(
        "dt_idx", "ret")


@query("a1_market_return_padded")
def a1_padded(spark, sf_dir):
    rets = M.padded_returns(I.brand_day_panel(spark, sf_dir, 130))
    return rounded(M.market_return(rets, I.brand_master(spark, sf_dir)), 8, "ret").select(
        "dt_idx", "ret")


@query("a30_master_quality")
def a30(spark, sf_dir):
    m = I.supplier_master(spark, sf_dir)
    named = m.withColumn("name", F.when(F.col("sector") != "NATION_9", F.col("name")))
    return M.master_quality(named)
