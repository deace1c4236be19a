"""Queries: stored analyses, priced-in annotation, provenance, scoring.

One stored analysis per customer and one synthesis (also a dated case file) per order, written as
JSON by Spark with the defects a validator must catch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import nodes as N
from tideline.operators import graph as R
from tideline.operators import groups as G
from tideline.operators import inference as V
from tideline.operators import names as NM
from tideline.operators import quotient as Cl
from tideline.operators import scoring as K
from tideline.operators import signals as sig
from tideline.operators import factors as X
from tideline.plans import horizontal as H
from tideline.plans import inputs as I
from tideline.plans import relations as Q
from tideline.plans.registry import query, rounded
from tideline.plans.screening import SCREEN
from tideline.plans.shared import dealt_by_file, kept, kept_files
from tideline.runtime import spread
from tideline.sources import records as J

HORIZON = 5
AS_OF = "2001-07-01"


def supplier_name(key: Column) -> Column:
    return F.concat(F.lit("Supplier#"), F.lpad(F.floor(key).cast("string"), 9, "0"))


@kept
def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    seg, bal, key = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_custkey")
    first = F.struct(
        F.when((seg == "HOUSEHOLD") & (bal > 9000), "").otherwise(supplier_name(key / 10)).alias("name"),
        F.when(bal > 8000, "중립").when(bal > 4000, S.IMPACT_LOSS).otherwise(S.IMPACT_GAIN).alias("impact"),
        F.lit("r").alias("reason"))
    second = F.struct(supplier_name(key / 15).alias("name"), F.lit(S.IMPACT_GAIN).alias("impact"),
                      F.lit("r").alias("reason"))
    path = F.struct(F.when(seg == "FURNITURE", "옆산업").otherwise("전방산업").alias("direction"),
                    F.col("n_name").alias("target_industry"), F.lit("l").alias("logic"),
                    F.array(first, second).alias("beneficiaries"))
    none = F.slice(F.array(path), 1, 0)
    doc = F.struct(
        F.lit("s").alias("cause_summary"), F.when(bal < 0, "X").otherwise(S.CAUSE_TYPES[0]).alias("cause_type"),
        F.when(seg.isin("BUILDING", "AUTOMOBILE"), S.SCOPE_COMPANY).otherwise(S.SCOPE_INDUSTRY).alias("cause_scope"),
        F.col("n_name").alias("industry"), F.when(seg != "MACHINERY", "e").alias("evidence"),
        F.lit("높음").alias("confidence"), F.lit("수직").alias("ripple_axis"),
        F.when(seg == "AUTOMOBILE", none).otherwise(F.array(path)).alias("ripple_paths"))
    payload = F.when(F.col("c_nationkey") < 2, "[1, 2]").otherwise(F.to_json(doc))
    return j.select(key.cast("string").alias("ticker"), payload.alias("payload"))


def _idea(status, priority):
    ben = F.struct(
        supplier_name(F.col("o_custkey") / 10).alias("name"), F.col("s_ticker").alias("ticker"),
        F.when(status == "F", S.IMPACT_LOSS).when(status == "O", S.IMPACT_GAIN).alias("impact"),
        F.when(priority == "1-URGENT", "모름").when(priority == "3-MEDIUM", "미반영").when(
            priority == "5-LOW", "기반영").otherwise("일부반영").alias("priced_in"),
        (F.pmod("o_custkey", F.lit(50)) / 1000.0).alias("gap"),
        (F.col("o_totalprice") > 250000).alias("graph_backed"),
        F.when(F.col("o_totalprice") > 250000, F.concat("n_name", F.lit("→동종"))).alias("via"),
        F.lit("c").alias("comment"))
    return F.struct(priority.alias("title"), F.when(status == "P", "대각").when(
        priority == "5-LOW", "수평").otherwise("수직").alias("axis"), F.lit("d").alias("driver"),
        F.lit("p").alias("path"), F.lit("w").alias("watch_points"), F.array(ben).alias("beneficiaries"))


@kept
def case_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a synthesis is written from, per order: a few narrow columns instead of its texts."""
    o = spread(I.table(spark, sf_dir, "orders"), "o_orderkey")
    c, n = I.table(spark, sf_dir, "customer"), I.table(spark, sf_dir, "nation")
    s = I.supplier_master(spark, sf_dir).select(F.col("ticker").alias("s_ticker"), F.col("name").alias("s_name"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(
        s, supplier_name(F.col("o_custkey") / 10) == F.col("s_name"), "left")
    return j.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "n_name", "s_ticker",
                    F.date_format("o_orderdate", "yyyyMMdd").alias("day"))


def written_cases(rows: DataFrame) -> DataFrame:
    """(file, run, payload, content): a synthesis per order, and the case file that holds it.

    The texts are far wider than the rows: whoever deals rows out does it before they become texts.
    """
    status, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    syn = F.struct(F.when(prio != "2-HIGH", "m").alias("market_summary"), F.array(_idea(status, prio)).alias("ideas"))
    doc = F.to_json(F.struct(F.col("day").alias("base_date"), syn.alias("synthesis")))
    torn = (status == "P") & (prio == "5-LOW")
    return rows.select(F.col("o_orderkey").alias("run"), F.concat(F.lit("cases/"), "day", F.lit(".json")).alias("file"),
                       F.to_json(syn).alias("payload"),
                       F.when(torn, F.left(doc, F.length(doc) - 9)).otherwise(doc).alias("content"))


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content) of every case document, by tasks of bounded size.

    Rows are dealt out while they are narrow. The columns are generated ones, since a reader's filter would otherwise
    write and parse the texts ahead of that shuffle, in as many tasks as the rows' files split into, and again after it.
    """
    rows = case_rows(spark, sf_dir)
    dealt = written_cases(spread(rows, "o_orderkey", rows=rows.count()))
    return dealt.select(F.inline(F.array(F.struct("file", "content"))))


@kept
def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.read_cases(case_files(spark, sf_dir))


@kept
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    return V.validate_analyses(spread(s, "ticker", rows=s.count()))


@kept
def validated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every synthesis read once, by tasks of bounded size.

    Narrow rows are dealt out; written before anybody filters, since a filter would read the texts ahead of that shuffle.
    """
    rows = case_rows(spark, sf_dir)
    dealt = spread(rows, "o_orderkey", rows=rows.count())
    return V.validate_synthesis(written_cases(dealt).select("run", "payload"))


@kept
def beneficiaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    syn = V.usable(validated_cases(spark, sf_dir))
    return V.analysis_beneficiaries(V.usable(validated(spark, sf_dir))).unionByName(
        V.synthesis_beneficiaries(syn))


@kept
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = beneficiaries(spark, sf_dir)
    res = NM.resolve(b, I.supplier_master(spark, sf_dir), Q.index(spark, sf_dir), "name")
    rets = sig.compute_signals(I.supplier_panel(spark, sf_dir))
    return V.annotate_priced_in(b, res, rets, X.best_gap(H.gaps(spark, sf_dir)))


@kept
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysed tickers in order: the first of the screen."""
    top, _ = sig.screen(I.supplier_panel(spark, sf_dir), I.supplier_master(spark, sf_dir), SCREEN)
    return top.where(F.col("pos") <= Q.CAND_LIMIT).select("ticker", "pos")


@kept
def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = Cl.first_reach(Q.routes(spark, sf_dir), Q.classes(spark, sf_dir), Q.targets(spark, sf_dir), quota(spark, sf_dir))
    return V.with_provenance(annotated(spark, sf_dir), reach)


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = I.table(spark, sf_dir, "lineitem").select(
        I.supplier_ticker("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("day"),
        I.cents("l_extendedprice").alias("cents"), F.col("l_quantity").alias("qty"))
    # a supplier's days hold about a row each: dealt by ticker once, they serve the sums and the series
    return I._cells(li.repartition("ticker"), "ticker", "day").select("ticker", "day", "close")


@kept
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.aged_predictions(cases(spark, sf_dir), AS_OF, K.min_age_days(HORIZON))


@kept
def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.forward_returns(predictions(spark, sf_dir), supplier_days(spark, sf_dir), HORIZON)


@kept
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.score_rows(predictions(spark, sf_dir), forward(spark, sf_dir))


@query("c23_validate_analyses")
def c23(spark, sf_dir):
    return V.problem_rows(validated(spark, sf_dir), "ticker").select("ticker", "problem")


@query("c23_validate_synthesis")
def c23_synthesis(spark, sf_dir):
    return V.problem_rows(validated_cases(spark, sf_dir), "run").select("run", "problem")


@query("f10_scope_filter")
def f10(spark, sf_dir):
    return V.industry_wide(V.usable(validated(spark, sf_dir))).select("ticker", F.col("rec.industry").alias("industry"))


@query("c22_beneficiaries")
def c22(spark, sf_dir):
    return beneficiaries(spark, sf_dir).select("shape", "origin", "name", "impact")


@query("j10_annotate_priced_in")
def j10(spark, sf_dir):
    return rounded(annotated(spark, sf_dir).select("shape", "origin", "name", "ticker", "ret5", "ret20", "gap",
                                                   "gap_group"), 6, "ret5", "ret20", "gap")


@query("j10_match_stats")
def j10_stats(spark, sf_dir):
    return V.match_stats(annotated(spark, sf_dir))


@query("j10_unmatched_names")
def j10_unmatched(spark, sf_dir):
    return V.unmatched_names(annotated(spark, sf_dir))


@query("j11_provenance")
def j11(spark, sf_dir):
    return marked(spark, sf_dir).select("shape", "origin", "ticker", "graph_backed", "via")


@query("j11_provenance_stats")
def j11_stats(spark, sf_dir):
    return V.provenance_stats(marked(spark, sf_dir))


@query("j17_attach_membership")
def j17(spark, sf_dir):
    t = I.supplier_master(spark, sf_dir).select("ticker")
    g = G.inverse_membership(H.groups(spark, sf_dir))
    out = t.join(g, "ticker", "left").join(R.industry_names(Q.all_edges(spark, sf_dir)), "ticker", "left")
    return out.select("ticker", F.array_join("groups", "|").alias("groups"),
                      F.array_join("industries", "|").alias("industries"))


@query("t11_analysis_quota")
def t11(spark, sf_dir):
    """The first of the screen, in its order."""
    return quota(spark, sf_dir)


@kept_files
def edge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per source of edges, and torn lines (one per error event) in a file of their own."""
    lines = Q.all_edges(spark, sf_dir).select(F.concat("source", F.lit(".jsonl")).alias("file"),
                                              F.to_json(F.struct(*sorted(R.EDGE_COLUMNS))).alias("value"))
    torn = I.table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.lit("torn.jsonl").alias("file"), F.concat(F.lit('{"src": '), F.col("props")).alias("value"))
    return dealt_by_file(lines.unionByName(torn))


@query("s13_edges_jsonl")
def s13(spark, sf_dir):
    """Edges through their files and back, read by path among torn lines."""
    return J.read_edges(spark, edge_files(spark, sf_dir)).groupBy("source", "rel").agg(
        F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query("s13_edge_rejects")
def s13_rejects(spark, sf_dir):
    return J.rejected_edges(spark, edge_files(spark, sf_dir)).groupBy("file").agg(F.count("*").alias("n"))


@kept_files
def case_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case documents in a file per day, torn ones among them."""
    # a day's rows meet while they are narrow, in the order in which the files are written
    rows = case_rows(spark, sf_dir).hint("rebalance", "day").sortWithinPartitions("day")
    return written_cases(rows).select(F.substring_index("file", "/", -1).alias("file"), F.col("content").alias("value"))


@query("s14_case_source")
def s14(spark, sf_dir):
    """Documents of case files, read by path; the date is that of the file name."""
    c = J.load_cases(spark, case_folder(spark, sf_dir), whole=False)[0]
    return c.groupBy("base_date").agg(F.count("*").alias("n"), F.count("synthesis.market_summary").alias("told"))


@query("s14_case_rejects")
def s14_rejects(spark, sf_dir):
    """Torn documents by month, named like its first day's file."""
    rejects = J.load_cases(spark, case_folder(spark, sf_dir), whole=False)[1]
    month = F.concat(F.substring("file", 1, 6), F.lit("01.json"))
    return rejects.groupBy(month.alias("file")).agg(F.count("*").alias("n"))


@query("f7_age_filter")
def f7(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(p, 6, "gap").select("base_date", "idea", "axis", "name", "ticker", "impact", "priced_in", "gap",
                                       "graph_backed", "via")


@query("w8_forward_return")
def w8(spark, sf_dir):
    return rounded(forward(spark, sf_dir), 8, "forward_return")


@query("j16_forward_price")
def j16(spark, sf_dir):
    s = scored(spark, sf_dir)
    return rounded(s, 8, "forward_return").select("base_date", "idea", "name", "ticker", "forward_return")


@query("a13_score_summary")
def a13(spark, sf_dir):
    return rounded(K.summary(scored(spark, sf_dir)), 7, "mean", "median", "hit_rate")


@query("a14_directional_hit")
def a14(spark, sf_dir):
    return rounded(K.directional_hit_rate(scored(spark, sf_dir)), 7, "directional_hit_rate")


@query("a15_gap_validity")
def a15(spark, sf_dir):
    return rounded(K.gap_validity(scored(spark, sf_dir)), 7, "corr", "top_mean", "top_hit_rate")
