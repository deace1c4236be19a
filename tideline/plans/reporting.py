"""Queries: the industry flow graph and the report tables.

The industry graph joins nation maps with the relations that filings state about part types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import chains as Ch
from tideline.operators import disclosures as D
from tideline.operators import factors as X
from tideline.operators import graph as R
from tideline.operators import quotient as Cl
from tideline.operators import reports as T
from tideline.operators import signals as sig
from tideline.plans import horizontal as H
from tideline.plans import inputs as I
from tideline.plans import outcomes as O
from tideline.plans import relations as Q
from tideline.plans import texts as W
from tideline.plans.registry import query, rounded
from tideline.plans.screening import SCREEN
from tideline.plans.shared import kept


@kept
def industry_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    filing = D.filing_edges(W.folded(spark, sf_dir), W.industry_of(spark, sf_dir), Q.ASOF)
    return R.merge(Q.map_edges(spark, sf_dir), filing)


@kept
def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ch.flow_edges(industry_graph(spark, sf_dir))


@kept
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ch.relation_origins(industry_graph(spark, sf_dir))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of all sources with what their rollup reads, dealt out by the pair that it groups by."""
    m = I.supplier_master(spark, sf_dir)
    p = Q.profiles(spark, sf_dir)
    prof, _ = R.profile_trades(p, Q.NM.resolve(p, m, Q.index(spark, sf_dir), "other_name"), m, Q.ASOF)
    return R.merge(prof, W.trade_parts(spark, sf_dir)[0], W.contract_trades(spark, sf_dir),
                   columns=(*R.KEY, "product", "weight"), by=("src", "dst"))


@kept
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trade_rollup(trade_edges(spark, sf_dir))


@kept
def cycle_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ch.break_cycles(flow(spark, sf_dir))[1]


@kept
def acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow but for the edges cut to break its cycles."""
    return (flow(spark, sf_dir).where("supplier <> consumer").select("supplier", "consumer")
            .join(cycle_cuts(spark, sf_dir), ["supplier", "consumer"], "left_anti"))


@query("a24_flow_edges")
def a24(spark, sf_dir):
    return flow(spark, sf_dir)


@query("g16_flow_label")
def g16(spark, sf_dir):
    return Ch.flow_labels(industry_graph(spark, sf_dir))


@query("g11_orphan_industries")
def g11(spark, sf_dir):
    return Ch.orphan_industries(R.members(industry_graph(spark, sf_dir)), flow(spark, sf_dir))


@query("g8_cycle_break")
def g8(spark, sf_dir):
    """Edges dropped so that the rest has no cycle."""
    return cycle_cuts(spark, sf_dir)


@query("g9_layering")
def g9(spark, sf_dir):
    return Ch.layers(acyclic(spark, sf_dir))


@query("g9_layering_after_break")
def g9_broken(spark, sf_dir):
    """Layers with the cut edges that run against them: (node, layer, n_back), cuts from the node to a layer not above."""
    at = Ch.layers(acyclic(spark, sf_dir))
    ends = at.select(F.col("node").alias("consumer"), F.col("layer").alias("to"))
    back = (cycle_cuts(spark, sf_dir).join(at.withColumnRenamed("node", "supplier"), "supplier").join(ends, "consumer")
            .where("to <= layer").groupBy(F.col("supplier").alias("node")).agg(F.count("*").alias("n_back")))
    return at.join(back, "node", "left").select("node", "layer", F.coalesce("n_back", F.lit(0)).alias("n_back"))


@query("g7_transitive_closure")
def g7(spark, sf_dir):
    return Ch.closure(acyclic(spark, sf_dir))


@query("g6_chain_levels")
def g6(spark, sf_dir):
    o = origins(spark, sf_dir)
    up = o.where(F.col("rel") == S.REL_UPSTREAM).select(F.col("industry").alias("node"), F.col("other").alias("target"),
                                                        "n_origins")
    return Ch.chain_levels(o.select("industry").distinct(), up)


@query("t10_chain_levels")
def t10(spark, sf_dir):
    """The same chains in the direction of demand."""
    o = origins(spark, sf_dir)
    down = o.where(F.col("rel") == S.REL_DOWNSTREAM).select(F.col("industry").alias("node"),
                                                            F.col("other").alias("target"), "n_origins")
    return Ch.chain_levels(o.select("industry").distinct(), down)


@query("a19_trade_rollup")
def a19(spark, sf_dir):
    out = T.trades_in_order(trades(spark, sf_dir), I.supplier_master(spark, sf_dir))
    return out.select("seller", "buyer", "product", "weight")


@query("a20_cross_validation")
def a20(spark, sf_dir):
    return T.relation_kpis(industry_graph(spark, sf_dir), origins(spark, sf_dir))


@query("a20_relation_origins")
def a20_rows(spark, sf_dir):
    return origins(spark, sf_dir)


@query("t12_industry_rank")
def t12(spark, sf_dir):
    return T.industry_rank(industry_graph(spark, sf_dir), origins(spark, sf_dir))


@query("t12_top_neighbours")
def t12_neighbours(spark, sf_dir):
    return T.top_neighbours(origins(spark, sf_dir))


@query("a25_industry_makes")
def a25(spark, sf_dir):
    return T.industry_makes(industry_graph(spark, sf_dir))


@query("u7_search_index")
def u7(spark, sf_dir):
    return T.search_index(industry_graph(spark, sf_dir), origins(spark, sf_dir), I.supplier_master(spark, sf_dir))


@query("t5_members_by_cap")
def t5(spark, sf_dir):
    m = R.members(industry_graph(spark, sf_dir))
    return T.members_by_cap(m, I.supplier_master(spark, sf_dir), ["industry"]).select(
        "industry", "rank", "ticker", "market_cap", "others")


@query("t6_drivers_by_weight")
def t6(spark, sf_dir):
    return T.drivers_by_weight(Cl.driver_shares(Q.all_edges(spark, sf_dir))).select("ticker", "rank", "driver", "my_sign", "my_weight", "n_same", "n_opposite")


@query("a21_kpi_row")
def a21(spark, sf_dir):
    ideas = O.cases(spark, sf_dir).select(F.explode("synthesis.ideas").alias("i"))
    top, _ = sig.screen(I.supplier_panel(spark, sf_dir), I.supplier_master(spark, sf_dir), SCREEN)
    out = T.kpi_row(top, ideas, H.gaps(spark, sf_dir), Q.all_edges(spark, sf_dir),
                    O.marked(spark, sf_dir))
    return rounded(out, 6, "max_gap")


@query("a22_coverage_report")
def a22(spark, sf_dir):
    return T.coverage_holes(R.map_rows(Q.maps(spark, sf_dir)), Q.resolved_map_names(spark, sf_dir),
                            O.V.unmatched_names(O.annotated(spark, sf_dir)))


@query("c24_context_text")
def c24(spark, sf_dir):
    """The text handed to an analyst per ticker: neighbourhood, groups, lagging peers, factors."""
    e, m = Q.all_edges(spark, sf_dir), I.supplier_master(spark, sf_dir)
    t = m.select("ticker")
    gaps = H.gaps(spark, sf_dir)
    mine = H.groups(spark, sf_dir).join(t.select("ticker"), "ticker", "left_semi")
    ranked = X.ranked_exposures(H.exposures(spark, sf_dir), H.moves(spark, sf_dir))
    lines = T.context_lines(e, t, m, X.best_gap(gaps)).unionByName(
        T.horizontal_lines(mine, gaps, X.group_peers(gaps, t), ranked, m))
    return T.context_text(lines)
