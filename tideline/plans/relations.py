"""Queries: name resolution and the relation graph.

Listed companies are suppliers; customers are the unlisted counterparties. A nation's value-chain
map lists its suppliers (and a few customers nobody can resolve) and, upstream, the nations that
sell to it above par, each with its largest supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import nodes as N
from tideline.functions.names import normalize_industry, normalize_name
from tideline.operators import graph as R
from tideline.operators import quotient as Cl
from tideline.operators import groups as G
from tideline.operators import names as NM
from tideline.plans import horizontal as H
from tideline.plans import inputs as I
from tideline.plans.registry import query, rounded
from tideline.plans.shared import kept

ASOF = "20011101"
CAND_LIMIT = S.GraphSettings().max_candidates


@kept
def strong_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_nation, supplier_nation): sales at least 1.3 times the customer's par."""
    f = I.nation_flows(spark, sf_dir)
    par = f.groupBy("customer_nation").agg(F.sum("cents").alias("total"), F.count("*").alias("n"))
    return f.join(par, "customer_nation").where(
        (F.col("cents") * F.col("n") * 10 >= F.col("total") * 13)
        & (F.col("customer_nation") != F.col("supplier_nation"))).select(
            "customer_nation", "supplier_nation")


@kept
def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value-chain maps in long form."""
    s, n = I.table(spark, sf_dir, "supplier"), I.table(spark, sf_dir, "nation")
    c = I.table(spark, sf_dir, "customer")
    file_of = lambda col: F.concat(F.lower(col), F.lit(".yaml"))
    none = F.lit(None).cast("string")
    listed = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("industry"), F.when(
            F.col("s_acctbal") < 1000, F.concat(F.lit("x("), I.supplier_ticker("s_suppkey"), F.lit(")"))
        ).otherwise(F.col("s_name")).alias("company"))
    unlisted = c.where("c_acctbal < -900").join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("n_name").alias("industry"), F.col("c_name").alias("company"))
    own = listed.unionByName(unlisted).select(
        file_of("industry").alias("map_file"), "industry", F.lit("peers").alias("block"),
        none.alias("segment"), "company")
    lead = I.supplier_master(spark, sf_dir).where("market_cap is not null").groupBy("sector").agg(
        F.min_by("name", F.struct((-F.col("market_cap")).alias("k"), "ticker")).alias("company"))
    up = strong_flows(spark, sf_dir).join(
        lead.withColumnRenamed("sector", "supplier_nation"), "supplier_nation", "left").select(
            file_of("customer_nation").alias("map_file"), F.col("customer_nation").alias("industry"),
            F.lit("upstream").alias("block"), F.col("supplier_nation").alias("segment"), "company")
    return own.unionByName(up)


@kept
def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NM.name_index(I.supplier_master(spark, sf_dir))


@kept
def resolved_map_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NM.resolve(maps(spark, sf_dir), I.supplier_master(spark, sf_dir), index(spark, sf_dir))


@kept
def map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.map_edges(maps(spark, sf_dir), resolved_map_names(spark, sf_dir), ASOF)


@kept
def disclosed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships that suppliers state themselves: their nation, with a product."""
    sold = I.supplier_goods(spark, sf_dir).groupBy("l_suppkey", "p_name").agg(F.sum("cents").alias("cents"))
    best = sold.groupBy("l_suppkey").agg(
        F.min_by("p_name", F.struct((-F.col("cents")).alias("k"), "p_name")).alias("product"))
    m = best.select(I.supplier_ticker("l_suppkey").alias("ticker"), "product").join(
        I.supplier_master(spark, sf_dir), "ticker")
    return R.edges(m, src=N.ticker_node(F.col("ticker")), dst=N.industry_node(F.col("sector")),
                   rel=S.REL_MEMBER, source="dart", origin=F.col("ticker"), confidence=0.85,
                   product=F.col("product"), asof=ASOF, evidence=F.col("name"))


@kept
def horizontal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge(R.group_edges(H.groups(spark, sf_dir), H.gaps(spark, sf_dir), ASOF),
                   R.factor_edges(H.exposures(spark, sf_dir), ASOF))


@kept
def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge(map_edges(spark, sf_dir), disclosed_edges(spark, sf_dir),
                   horizontal_edges(spark, sf_dir))


@kept
def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Cl.classes(all_edges(spark, sf_dir))


@kept
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Cl.targets(all_edges(spark, sf_dir))


@kept
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Cl.routes(all_edges(spark, sf_dir), classes(spark, sf_dir))


def by_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, pos): all tickers, larger caps first, those without one last."""
    m = I.supplier_master(spark, sf_dir)
    return m.select("ticker", F.coalesce(-F.col("market_cap"), F.lit(1)).alias("pos"))


def with_members(found: DataFrame, cls: DataFrame) -> DataFrame:
    """Rows per class, and ``member`` rows that name the tickers of every class."""
    return found.unionByName(cls.select(F.lit("member").alias("part"), "class_id", "ticker"), allowMissingColumns=True)


@kept
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers of every supplier by name (ten customers share one): even ones buy, odd ones supply."""
    party = F.floor(F.col("o_custkey") / 10).alias("party")
    each = I.supplier_customers(spark, sf_dir).select("l_suppkey", party).distinct()
    return each.select(I.supplier_ticker("l_suppkey").alias("ticker"),
                       F.when(F.col("party") % 2 == 0, "customers").otherwise("suppliers").alias("side"),
                       F.concat(F.lit("Supplier#"), F.lpad(F.col("party").cast("string"), 9, "0")).alias("other_name"),
                       F.concat(F.lit("goods of "), F.col("party").cast("string")).alias("products"),
                       F.lit("handbook").alias("source"))


def shown(df: DataFrame) -> DataFrame:
    return df.select(*R.EDGE_COLUMNS)


def part_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as securities whose names collide heavily."""
    p = I.table(spark, sf_dir, "part")
    return p.select(I.supplier_ticker("p_partkey").alias("ticker"), F.concat(
        F.lit("㈜ "), "p_name").alias("name"), F.round(F.col("p_retailprice") * 100).cast("long")
        .alias("market_cap"))


@query("c1_normalize_name")
def c1(spark, sf_dir):
    p = part_master(spark, sf_dir)
    return p.select("ticker", normalize_name(F.concat(F.col("name"), F.lit(" (주)"))).alias("norm_name"))


@query("a29_name_index")
def a29(spark, sf_dir):
    return NM.name_index(part_master(spark, sf_dir))


@query("a29_name_collisions")
def a29_collisions(spark, sf_dir):
    p = part_master(spark, sf_dir)
    return NM.name_collisions(p, NM.name_index(p))


@query("j4_name_resolution")
def j4(spark, sf_dir):
    return resolved_map_names(spark, sf_dir)


@query("j4_unresolved_names")
def j4_unresolved(spark, sf_dir):
    return NM.unresolved(resolved_map_names(spark, sf_dir))


@query("c2_near_misses")
def c2(spark, sf_dir):
    names = I.table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_type")
                                                  .alias("company"))
    return NM.near_misses(names, NM.name_index(part_master(spark, sf_dir)))


@query("s11_map_source")
def s11(spark, sf_dir):
    return R.map_rows(maps(spark, sf_dir)).select("map_file", "industry", "block", "target", "company")


@query("g1_map_edges")
def g1(spark, sf_dir):
    return shown(R.merge(map_edges(spark, sf_dir)))


@query("g2_exposure_edges")
def g2(spark, sf_dir):
    e = horizontal_edges(spark, sf_dir)
    return shown(e).drop("evidence")


@query("g3_profile_trades")
def g3(spark, sf_dir):
    m = I.supplier_master(spark, sf_dir)
    p = profiles(spark, sf_dir)
    e, _ = R.profile_trades(p, NM.resolve(p, m, index(spark, sf_dir), "other_name"), m, ASOF)
    return shown(R.merge(e))


@query("g3_profile_unresolved")
def g3_unresolved(spark, sf_dir):
    m = I.supplier_master(spark, sf_dir)
    p = profiles(spark, sf_dir)
    return R.profile_trades(p, NM.resolve(p, m, index(spark, sf_dir), "other_name"), m, ASOF)[1]


@query("u1_edge_union")
def u1(spark, sf_dir):
    return all_edges(spark, sf_dir).select("src", "dst", "rel", "sign", "weight", "source", "origin",
                                           "confidence", "product")


@query("w11_edge_latest")
def w11(spark, sf_dir):
    """Orders restate the trade relation supplier nation -> customer; the newest statement wins."""
    o = I.table(spark, sf_dir, "orders")
    e = R.edges(o, src=N.ticker_node(F.col("o_custkey").cast("string")),
                dst=N.driver_node(F.col("o_orderpriority")), rel=S.REL_EXPOSURE,
                source="factor_beta", weight=F.col("o_totalprice") / 7919,
                asof=F.date_format("o_orderdate", "yyyyMMdd"),
                pos=F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return R.merge(e).select("src", "dst", "weight", "asof")


@query("u3_source_partition")
def u3(spark, sf_dir):
    return R.persistent_only(all_edges(spark, sf_dir)).groupBy("source", "rel").agg(
        F.count("*").alias("n"))


@query("f4_edge_filter")
def f4(spark, sf_dir):
    return R.pick(all_edges(spark, sf_dir), S.REL_EXPOSURE, 0.2).select(
        "src", "dst", "source", "confidence")


@query("f6_industry_scope_filter")
def f6(spark, sf_dir):
    return G.industry_groups(all_edges(spark, sf_dir))


@query("j5_vertical_2hop")
def j5(spark, sf_dir):
    """Two-hop paths of every class of tickers, and the tickers of every class."""
    e, c = all_edges(spark, sf_dir), classes(spark, sf_dir)
    return with_members(Cl.class_paths(e, c).drop("evidence").withColumn("part", F.lit("path")), c)


@query("j6_peers")
def j6(spark, sf_dir):
    """The industries whose members are peers of a class, and the tickers of every class."""
    e, c = all_edges(spark, sf_dir), classes(spark, sf_dir)
    return with_members(Cl.class_industries(e, c).withColumn("part", F.lit("industry")), c)


@query("j7_co_exposed")
def j7(spark, sf_dir):
    """Every exposure that other tickers share, with how many move with or against the driver, and who they are."""
    return Cl.co_exposures(all_edges(spark, sf_dir))


@query("g10_subgraph")
def g10(spark, sf_dir):
    return Cl.neighbourhood(all_edges(spark, sf_dir), classes(spark, sf_dir))


@query("g5_reachability")
def g5(spark, sf_dir):
    """Under which label a class reaches the members of an industry or driver, and the tickers of every class."""
    found = routes(spark, sf_dir).select("class_id", "kind", "target", "prio", "via", F.lit("route").alias("part"))
    return with_members(found, classes(spark, sf_dir))


@query("g5_reach_overall")
def g5_overall(spark, sf_dir):
    return Cl.first_reach(routes(spark, sf_dir), classes(spark, sf_dir), targets(spark, sf_dir), by_cap(spark, sf_dir))


@query("j12_product_backfill")
def j12(spark, sf_dir):
    p = profiles(spark, sf_dir).where("side = 'customers'").groupBy("ticker").agg(F.min("products").alias("products"))
    e = R.backfill_products(R.merge(map_edges(spark, sf_dir), disclosed_edges(spark, sf_dir)), p)
    return e.where(F.col("rel") == S.REL_MEMBER).select("src", "dst", "source", "origin", "product")


def preferred_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, plus one preferred share per supplier whose ticker ends in 0 or 9."""
    m = I.supplier_master(spark, sf_dir).select("ticker", "name")
    pref = m.where(F.substring("ticker", 6, 1).isin("0", "9")).select(
        F.concat(F.substring("ticker", 1, 5), F.when(F.substring("ticker", 6, 1) == "0", "K")
                 .otherwise("L")).alias("ticker"), F.concat("name", F.lit("2우B")).alias("name"))
    return m.where(F.substring("ticker", 5, 1) != "7").unionByName(pref)


def mapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships without the suppliers numbered x7x: their preferred shares are orphans."""
    e = R.merge(map_edges(spark, sf_dir), disclosed_edges(spark, sf_dir))
    return e.where(F.substring(N.node_value(F.col("src")), 5, 1) != "7")


@query("j13_preferred_inherit")
def j13(spark, sf_dir):
    e, _ = R.inherit_preferred(mapped_edges(spark, sf_dir), preferred_master(spark, sf_dir), ASOF)
    return R.merge(e).select("src", "dst", "source", "origin", "confidence", "product", "evidence")


@query("j13_preferred_orphans")
def j13_orphans(spark, sf_dir):
    return R.inherit_preferred(mapped_edges(spark, sf_dir), preferred_master(spark, sf_dir), ASOF)[1]


@query("c20_split_node")
def c20(spark, sf_dir):
    e = all_edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))
                                                             ).distinct()
    bare = nodes.unionByName(I.supplier_master(spark, sf_dir).select(F.col("ticker").alias("node")))
    return bare.select("node", N.node_kind(F.col("node")).alias("kind"),
                       N.node_value(F.col("node")).alias("value"))


@query("u6_industry_vocabulary")
def u6(spark, sf_dir):
    return NM.industry_vocabulary(all_edges(spark, sf_dir), R.map_rows(maps(spark, sf_dir)))


def spoken_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry names as people write them: part names and types with Korean suffixes."""
    p = I.table(spark, sf_dir, "part")
    size = F.col("p_size")
    name = (F.when(size < 10, F.concat("p_type", F.lit(" 산업")))
            .when(size < 20, F.concat("p_name", F.lit(" 제조업 부문")))
            .when(size < 30, F.concat(F.split("p_name", " ")[1], F.lit("사업부문")))
            .when(size < 40, F.concat(F.lower("p_type"), F.lit("·업계")))
            .otherwise(F.split("p_name", " ")[1]))
    return p.select(name.alias("name"), F.col("p_partkey").alias("pos"))


def known_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "part").select(F.col("p_type").alias("industry")).distinct()


def industry_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = I.table(spark, sf_dir, "part").select(F.split("p_name", " ")[1].alias("alias")).distinct()
    return n.where("alias like 'g%'").select("alias", F.lit("STANDARD").alias("target"))


@query("c3_normalize_industry")
def c3(spark, sf_dir):
    return spoken_industries(spark, sf_dir).select("name").distinct().select(
        "name", normalize_industry(F.col("name")).alias("norm"))


@query("c4_resolve_industry")
def c4(spark, sf_dir):
    return NM.resolve_industries(spoken_industries(spark, sf_dir), known_industries(spark, sf_dir),
                                 industry_aliases(spark, sf_dir))


@query("a26_new_industry_counts")
def a26(spark, sf_dir):
    said = spoken_industries(spark, sf_dir)
    counts = said.groupBy("name").agg(F.count("*").alias("n"))
    res = NM.resolve_industries(said, known_industries(spark, sf_dir),
                                industry_aliases(spark, sf_dir))
    return NM.new_industry_counts(res.join(counts, "name"))


@query("c5_alias_suggestions")
def c5(spark, sf_dir):
    fresh = I.table(spark, sf_dir, "part").select(
        F.concat(F.split("p_name", " ")[0], F.lit(" "), F.split("p_name", " ")[1])
        .alias("industry")).distinct()
    known = I.table(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("industry")).distinct()
    return NM.alias_suggestions(fresh, known)
