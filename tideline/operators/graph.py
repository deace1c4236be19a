"""The relation graph: one typed edge table, built from several sources of evidence.

Nodes are prefixed strings; an edge always names its source and origin, and the same relation from
two origins stays two edges. Lookups take the tickers asked about as a table, so their cost follows
the neighbourhood of those tickers, never the square of an industry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import nodes as N

CFG = S.GraphSettings()

EDGE_SCHEMA = ("src string, dst string, rel string, sign int, weight double, source string, "
               "origin string, confidence double, evidence string, asof string, product string, "
               "attribution string")
EDGE_COLUMNS = tuple(x.split()[0] for x in EDGE_SCHEMA.split(", "))
KEY = ("src", "dst", "rel", "source", "origin")


def edges(df: DataFrame, *, src: Column, dst: Column, rel: Column | str, source: Column | str,
          sign=0, weight=None, confidence=0.5, evidence="", asof="", origin="", product="",
          attribution="", pos: Column | None = None) -> DataFrame:
    """Edge rows out of ``df``; weights keep 4 decimals, confidences 3. ``pos`` orders restatements."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    text = lambda v: F.coalesce(lit(v), F.lit(""))
    out = df.select(
        src.alias("src"), dst.alias("dst"), lit(rel).alias("rel"), lit(sign).cast("int").alias("sign"),
        F.round(lit(weight).cast("double"), 4).alias("weight"), lit(source).alias("source"),
        text(origin).alias("origin"), F.round(lit(confidence).cast("double"), 3).alias("confidence"),
        text(evidence).alias("evidence"), text(asof).alias("asof"), text(product).alias("product"),
        text(attribution).alias("attribution"),
        (pos if pos is not None else F.lit("")).cast("string").alias("pos"))
    return out


def known_relations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid edges, rejects): an unknown relation type never enters the graph."""
    ok = F.coalesce(F.col("rel").isin(*S.RELATIONS), F.lit(False))
    return df.where(ok), df.where(~ok)


def opposite(rel: Column) -> Column:
    return (F.when(rel == S.REL_UPSTREAM, S.REL_DOWNSTREAM)
            .when(rel == S.REL_DOWNSTREAM, S.REL_UPSTREAM))


def merge(*lists: DataFrame, columns: tuple[str, ...] = EDGE_COLUMNS, by: tuple[str, ...] = ()) -> DataFrame:
    """Union of edge lists; per key the newest ``asof`` wins, later lists and rows break ties.

    Columns other than ``columns`` are not carried. With ``by``, part of the key that is spread as well as the
    whole, rows are dealt out and sorted once for the merge and for what is then grouped by those columns.
    """
    tagged = []
    for i, e in enumerate(lists):
        pos = F.col("pos") if "pos" in e.columns else F.lit("")
        tagged.append(e.select(*EDGE_COLUMNS, F.lit(i).alias("_list"), pos.alias("_pos")))
    union = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in columns if c not in KEY]
    last = F.max_by(F.struct(*rest), F.struct("asof", "_list", "_pos", "evidence")).alias("r")
    if by:
        union = union.repartition(*by)
    return union.groupBy(*KEY).agg(last).select(
        *[F.col(c) if c in KEY else F.col(f"r.{c}").alias(c) for c in columns])


def persistent_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("source").isin(*S.PERSISTENT_SOURCES))


def pick(df: DataFrame, rel: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    out = df.where(F.col("confidence") >= min_confidence)
    return out if rel is None else out.where(F.col("rel") == rel)


def memberships(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Membership edges as (ticker, industry, confidence, source, origin, product)."""
    m = pick(df, S.REL_MEMBER, min_confidence).where(
        (N.node_kind(F.col("src")) == "T") & (N.node_kind(F.col("dst")) == "I"))
    return m.select(N.node_value(F.col("src")).alias("ticker"),
                    N.node_value(F.col("dst")).alias("industry"),
                    "confidence", "source", "origin", "product")


def members(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Distinct (industry, ticker)."""
    return memberships(df, min_confidence).select("industry", "ticker").distinct()


def industry_names(df: DataFrame) -> DataFrame:
    """ticker -> its industries, distinct and ordered (a ticker has few)."""
    return members(df).groupBy("ticker").agg(
        F.sort_array(F.collect_set("industry")).alias("industries"))


def vertical(df: DataFrame, tickers: DataFrame, rel: str, min_confidence: float = 0.0) -> DataFrame:
    """ticker -> own industry -> up- or downstream industry.

    One row per (ticker, from_industry, industry): best path confidence (product of both edges, 3
    decimals), the source and evidence of that best path, and all sources that state it.
    """
    own = memberships(df, min_confidence).join(tickers.select("ticker"), "ticker", "left_semi")
    own = own.select("ticker", F.col("industry").alias("from_industry"),
                     F.col("confidence").alias("c1"), F.col("source").alias("s1"),
                     F.col("origin").alias("o1"))
    ve = pick(df, rel, min_confidence).where(N.node_kind(F.col("src")) == "I").select(
        N.node_value(F.col("src")).alias("from_industry"), N.node_value(F.col("dst")).alias("industry"),
        F.col("confidence").alias("c2"), F.col("source").alias("s2"), F.col("origin").alias("o2"),
        "evidence")
    path = own.join(ve, "from_industry").withColumn("conf", F.round(F.col("c1") * F.col("c2"), 3))
    first_best = F.struct((-F.col("conf")).alias("k"), "s1", "o1", "s2", "o2")
    return path.groupBy("ticker", "from_industry", "industry").agg(
        F.max("conf").alias("confidence"), F.min_by("s2", first_best).alias("source"),
        F.min_by("evidence", first_best).alias("evidence"),
        F.array_join(F.sort_array(F.collect_set("s2")), "+").alias("sources")
    ).withColumn("relation", F.lit(rel))


def peers(df: DataFrame, tickers: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(ticker, industry, other) for the tickers asked about."""
    m = members(df, min_confidence)
    mine = m.join(tickers.select("ticker"), "ticker", "left_semi")
    return mine.join(m.withColumnRenamed("ticker", "other"), "industry").where(
        F.col("other") != F.col("ticker")).select("ticker", "industry", "other")


def exposed(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Exposure edges as (ticker, driver, sign, weight, source)."""
    return pick(df, S.REL_EXPOSURE, min_confidence).where(N.node_kind(F.col("dst")) == "D").select(
        N.node_value(F.col("src")).alias("ticker"), N.node_value(F.col("dst")).alias("driver"),
        "sign", "weight", "source")


def co_exposed(df: DataFrame, tickers: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(ticker, driver, my_sign, my_weight, source, other, sign, weight, other_source)."""
    ex = exposed(df, min_confidence)
    mine = ex.join(tickers.select("ticker"), "ticker", "left_semi").select(
        "ticker", "driver", F.col("sign").alias("my_sign"), F.col("weight").alias("my_weight"), "source")
    others = ex.select("driver", F.col("ticker").alias("other"), "sign", "weight",
                       F.col("source").alias("other_source"))
    return mine.join(others, "driver").where(F.col("other") != F.col("ticker"))


def subgraph(df: DataFrame, tickers: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Neighbourhood of each ticker as typed rows (ticker, part, via, other, sign, confidence)."""
    mem = members(df, min_confidence)
    own = mem.join(tickers.select("ticker"), "ticker", "left_semi").select(
        "ticker", F.lit("industry").alias("part"), F.col("industry").alias("via"),
        F.lit(None).cast("string").alias("other"), F.lit(None).cast("int").alias("sign"),
        F.lit(None).cast("double").alias("confidence"))
    per = peers(df, tickers, min_confidence).select(
        "ticker", F.lit("peer").alias("part"), F.col("industry").alias("via"), "other",
        F.lit(None).cast("int").alias("sign"), F.lit(None).cast("double").alias("confidence"))
    parts = [own, per]
    for rel, name in ((S.REL_UPSTREAM, "upstream"), (S.REL_DOWNSTREAM, "downstream")):
        v = vertical(df, tickers, rel, min_confidence).join(
            mem.withColumnRenamed("ticker", "other"), "industry", "left")
        parts.append(v.select(
            "ticker", F.lit(name).alias("part"),
            F.concat_ws(">", "from_industry", "industry").alias("via"), "other",
            F.lit(None).cast("int").alias("sign"), "confidence"))
    drv = co_exposed(df, tickers, min_confidence).select(
        "ticker", F.lit("driver").alias("part"), F.col("driver").alias("via"), "other", "sign",
        F.lit(None).cast("double").alias("confidence")).distinct()
    return reduce(DataFrame.unionByName, parts + [drv])


def reachability(df: DataFrame, tickers: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(ticker, pos, other, via): the first label under which ``other`` is reached.

    Upstream comes before downstream, then peers, then shared drivers. Within one kind the more
    confident path comes first, then the label by name. ``tickers`` carries a position ``pos``.
    """
    mem = members(df, min_confidence).withColumnRenamed("ticker", "other")
    parts = []
    for prio, rel in enumerate((S.REL_UPSTREAM, S.REL_DOWNSTREAM)):
        v = vertical(df, tickers, rel, min_confidence).join(mem, "industry")
        parts.append(v.select(
            "ticker", "other", F.lit(prio).alias("prio"), (-F.col("confidence")).alias("conf"),
            F.concat("from_industry", F.lit(f"→{rel}→"), "industry").alias("via")))
    parts.append(peers(df, tickers, min_confidence).select(
        "ticker", "other", F.lit(2).alias("prio"), F.lit(0.0).alias("conf"),
        F.concat("industry", F.lit("→" + S.PEER_LABEL)).alias("via")))
    parts.append(co_exposed(df, tickers, min_confidence).select(
        "ticker", "other", F.lit(3).alias("prio"), F.lit(0.0).alias("conf"),
        F.concat(F.lit(S.DRIVER_LABEL), "driver").alias("via")))
    allp = reduce(DataFrame.unionByName, parts).where(F.col("other") != F.col("ticker"))
    best = allp.groupBy("ticker", "other").agg(
        F.min(F.struct("prio", "conf", "via")).alias("b"))
    return best.join(tickers.select("ticker", "pos"), "ticker").select(
        "ticker", "pos", "other", F.col("b.prio").alias("prio"), F.col("b.via").alias("via"))


def reach_overall(reach: DataFrame) -> DataFrame:
    """(ticker, via): for a reached ticker, the label from the first analysed ticker."""
    return reach.groupBy(F.col("other").alias("ticker")).agg(
        F.min_by("via", F.struct("pos", "prio", "via")).alias("via"))


# ---- building edges -----------------------------------------------------------------------

def map_edges(maps: DataFrame, resolved: DataFrame, asof: str, cfg: S.GraphSettings = CFG
              ) -> DataFrame:
    """Value-chain map rows -> membership edges and both directions of every relation.

    ``maps(map_file, industry, block, segment, company)`` in long form, peers without a segment;
    ``resolved(company, ticker)`` comes from the name resolver.
    """
    rows = map_rows(maps)
    pos = F.concat_ws("|", "map_file", F.col("block_order").cast("string"), "target", "company")
    mem = rows.where(F.col("company").isNotNull()).join(
        resolved.where(F.col("ticker").isNotNull()), "company")
    member = edges(mem, src=N.ticker_node(F.col("ticker")), dst=N.industry_node(F.col("target")),
                   rel=S.REL_MEMBER, source="valuechain", confidence=cfg.map_confidence,
                   evidence=F.concat_ws(": ", "map_file", "company"), asof=asof, pos=pos)
    flow = rows.where(F.col("block") != "peers").select(
        "map_file", "industry", "target", "rel", "block_order").distinct()
    fpos = F.concat_ws("|", "map_file", F.col("block_order").cast("string"))
    fwd = edges(flow, src=N.industry_node(F.col("industry")), dst=N.industry_node(F.col("target")),
                rel=F.col("rel"), source="valuechain", confidence=cfg.map_confidence,
                evidence=F.col("map_file"), asof=asof, pos=fpos)
    back = edges(flow, src=N.industry_node(F.col("target")), dst=N.industry_node(F.col("industry")),
                 rel=opposite(F.col("rel")), source="valuechain", confidence=cfg.map_confidence,
                 evidence=F.col("map_file"), asof=asof, pos=fpos)
    return member.unionByName(fwd).unionByName(back)


def map_rows(maps: DataFrame) -> DataFrame:
    """Usable map rows: underscore files are not maps, relations need a segment."""
    block = F.col("block")
    rows = maps.where(~F.col("map_file").startswith("_") & F.col("industry").isNotNull())
    rows = rows.where((block == "peers") | (F.coalesce("segment", F.lit("")) != ""))
    return rows.select(
        "map_file", "industry", "block", "company",
        F.when(block == "peers", F.col("industry")).otherwise(F.col("segment")).alias("target"),
        F.when(block == "upstream", S.REL_UPSTREAM).when(block == "downstream", S.REL_DOWNSTREAM)
        .alias("rel"),
        F.when(block == "peers", 0).when(block == "upstream", 1).otherwise(2).alias("block_order"))


def group_edges(group_members: DataFrame, gaps: DataFrame, asof: str,
                cfg: S.GraphSettings = CFG) -> DataFrame:
    """Theme and basket membership -> positive exposure; industry groups are never drivers."""
    m = group_members.where(~F.col("grp").startswith(S.INDUSTRY_GROUP_PREFIX)).join(
        gaps.select("grp", "ticker", F.round("beta", 2).alias("beta")), ["grp", "ticker"], "left")
    theme = F.col("grp").startswith(S.THEME_GROUP_PREFIX)
    return edges(m, src=N.ticker_node(F.col("ticker")), dst=N.driver_node(F.col("grp")),
                 rel=S.REL_EXPOSURE, source=F.when(theme, "theme_index").otherwise("etf_pdf"),
                 sign=1, weight=F.col("beta"), evidence=F.col("grp"), asof=asof,
                 confidence=F.when(theme, cfg.theme_confidence).otherwise(cfg.basket_confidence))


def factor_edges(exposures: DataFrame, asof: str, cfg: S.GraphSettings = CFG) -> DataFrame:
    """Factor betas -> signed exposure. The sign is the point of the edge."""
    e = exposures.select("ticker", "factor", F.round("beta", 3).alias("beta"),
                         F.round("corr", 3).alias("corr"))
    return edges(e, src=N.ticker_node(F.col("ticker")), dst=N.driver_node(F.col("factor")),
                 rel=S.REL_EXPOSURE, source="factor_beta",
                 sign=F.when(F.col("beta") >= 0, 1).otherwise(-1), weight=F.col("beta"),
                 confidence=F.least(F.lit(cfg.factor_confidence_cap), F.abs("corr")),
                 evidence=F.format_string("β%+.2f (상관 %+.2f)", "beta", "corr"), asof=asof)


def profile_trades(profiles: DataFrame, resolved: DataFrame, master: DataFrame, asof: str,
                   cfg: S.GraphSettings = CFG) -> tuple[DataFrame, DataFrame]:
    """(company -> company edges along the flow of goods, unresolved names).

    ``profiles(ticker, side, other_name, products, source)`` with side customers or suppliers.
    """
    p = profiles.join(master.select("ticker", F.lit(True).alias("listed")), "ticker", "left").join(
        resolved.select(F.col("company").alias("other_name"), F.col("ticker").alias("other")),
        "other_name", "left")
    listed = F.coalesce(F.col("listed"), F.lit(False))
    bad = p.where(~listed | F.col("other").isNull()).select(
        "ticker", F.when(listed, F.col("other_name")).alias("other_name")).distinct()
    good = p.where(listed & F.col("other").isNotNull() & (F.col("other") != F.col("ticker")))
    fwd = F.col("side") == "customers"
    out = edges(good, src=N.ticker_node(F.when(fwd, F.col("ticker")).otherwise(F.col("other"))),
                dst=N.ticker_node(F.when(fwd, F.col("other")).otherwise(F.col("ticker"))),
                rel=S.REL_DOWNSTREAM, source="profile", origin=F.col("ticker"), asof=asof,
                confidence=cfg.profile_confidence, product=F.col("products"),
                evidence=F.col("source"),
                pos=F.concat_ws("|", F.when(fwd, F.lit("0")).otherwise(F.lit("1")), "other_name"))
    return out, bad


def backfill_products(df: DataFrame, products: DataFrame) -> DataFrame:
    """Membership edges without a product take the profile's; a disclosed product stays."""
    p = products.select(N.ticker_node(F.col("ticker")).alias("src"),
                        F.col("products").alias("_fill"))
    fill = (F.col("rel") == S.REL_MEMBER) & (F.coalesce("product", F.lit("")) == "")
    return df.join(p, "src", "left").withColumn(
        "product", F.when(fill, F.coalesce("_fill", "product")).otherwise(F.col("product"))
    ).drop("_fill").select(*df.columns)


def inherit_preferred(df: DataFrame, master: DataFrame, asof: str) -> tuple[DataFrame, DataFrame]:
    """(membership copied from the common share, preferred shares whose common is unmapped)."""
    member = df.where((F.col("rel") == S.REL_MEMBER) & F.col("src").startswith("T:"))
    mapped = member.select(N.node_value(F.col("src")).alias("ticker")).distinct()
    pref = master.where(F.coalesce(F.col("name").rlike(S.PREFERRED_NAME), F.lit(False))).join(
        mapped, "ticker", "left_anti").select(
            F.col("ticker").alias("pref"), F.col("name").alias("pref_name"),
            F.concat(F.substring("ticker", 1, 5), F.lit("0")).alias("common"))
    names = master.select(F.col("ticker").alias("common"), F.col("name").alias("common_name"))
    hit = pref.join(member.withColumn("common", N.node_value(F.col("src"))), "common").join(
        names, "common", "left")
    out = edges(hit, src=N.ticker_node(F.col("pref")), dst=F.col("dst"), rel=S.REL_MEMBER,
                source="preferred", origin=F.col("common"), asof=asof,
                confidence=F.col("confidence"), product=F.col("product"),
                evidence=F.concat("pref_name", F.lit("는 "), "common_name", F.lit("("), "common",
                                  F.lit(")의 우선주로 같은 회사다. 소속은 본주와 같다.")),
                pos=F.concat_ws("|", "source", "origin"))
    orphans = pref.join(mapped.withColumnRenamed("ticker", "common"), "common", "left_anti").select(
        F.col("pref").alias("ticker"), F.col("pref_name").alias("name"))
    return out, orphans
