"""Tables behind the reports: trades, coverage, indicators, neighbourhood texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import nodes as N
from tideline.operators import graph as R
from tideline.operators import quotient as Q

CFG = S.GraphSettings()


def trade_rollup(edges: DataFrame) -> DataFrame:
    """(seller, buyer, product, weight): the longest product text and the largest weight of a pair."""
    t = edges.where((N.node_kind(F.col("src")) == "T") & (N.node_kind(F.col("dst")) == "T")
                    & (F.col("rel") == S.REL_DOWNSTREAM))
    text = F.coalesce("product", F.lit(""))
    return t.groupBy("src", "dst").agg(
        F.min_by(text, F.struct((-F.length(text)).alias("k"), text.alias("t"))).alias("product"),
        F.max("weight").alias("weight")).select(
            N.node_value(F.col("src")).alias("seller"), N.node_value(F.col("dst")).alias("buyer"), "product", "weight")


def trades_in_order(rollup: DataFrame, master: DataFrame) -> DataFrame:
    """Weighted trades first, heaviest first, then by the seller's name."""
    named = rollup.join(master.select(F.col("ticker").alias("seller"), "name"), "seller", "left")
    return named.orderBy(F.col("weight").isNull(), F.col("weight").desc(), F.coalesce("name", "seller"), "buyer")


def relation_kpis(edges: DataFrame, relation_origins: DataFrame) -> DataFrame:
    """One row: industries, member stocks, relations, relations with two or more origins."""
    mem = R.members(edges)
    named = mem.select("industry").unionByName(relation_origins.select("industry")).agg(
        F.countDistinct("industry").alias("n_industries"))
    stocks = mem.agg(F.countDistinct("ticker").alias("n_stocks"))
    rel = relation_origins.agg(F.count("*").alias("n_relations"), F.count_if(
        (F.col("rel") == S.REL_UPSTREAM) & (F.col("n_origins") >= 2)).alias("n_cross"))
    # three one-row tables
    return named.join(F.broadcast(stocks)).join(F.broadcast(rel))


def industry_rank(edges: DataFrame, relation_origins: DataFrame) -> DataFrame:
    """(industry, n_members, n_up, n_down, score): most connected industries first."""
    k = R.members(edges).groupBy("industry").agg(F.count("*").alias("n_members"))
    d = relation_origins.groupBy("industry").agg(
        F.count_if(F.col("rel") == S.REL_UPSTREAM).alias("n_up"),
        F.count_if(F.col("rel") == S.REL_DOWNSTREAM).alias("n_down"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = k.join(d, "industry", "full").select("industry", zero("n_members"), zero("n_up"), zero("n_down"))
    return j.withColumn("score", 2 * F.col("n_members") + F.col("n_up") + F.col("n_down")).orderBy(
        F.col("score").desc(), "industry")


def top_neighbours(relation_origins: DataFrame, limit: int = 4) -> DataFrame:
    w = Window.partitionBy("industry", "rel").orderBy(F.col("n_origins").desc(), "other")
    return relation_origins.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def industry_makes(edges: DataFrame) -> DataFrame:
    """(industry, ticker, has_product, products): what each member makes in that industry."""
    m = R.memberships(edges)
    prods = F.filter(F.collect_set(F.coalesce("product", F.lit(""))), lambda p: p != "")
    return m.groupBy("industry", "ticker").agg(F.sort_array(prods).alias("p")).select(
        "industry", "ticker", (F.size("p") > 0).alias("has_product"), F.array_join("p", " · ").alias("products"))


def members_by_cap(members: DataFrame, master: DataFrame, key: list[str], limit: int = CFG.max_members) -> DataFrame:
    """The largest members of each key, and how many more there are."""
    caps = members.join(master.select("ticker", "name", "market_cap"), "ticker", "left")
    w = Window.partitionBy(*key).orderBy(F.coalesce("market_cap", F.lit(0)).desc(), "ticker")
    top = caps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    size = members.groupBy(*key).agg(F.count("*").alias("n"))
    return top.join(size, key).withColumn("others", F.greatest(F.col("n") - limit, F.lit(0))).drop("n")


def drivers_by_weight(shares: DataFrame, limit: int = CFG.max_drivers) -> DataFrame:
    """A ticker's strongest drivers that others share (``quotient.driver_shares``), with how many move with or against it."""
    w = Window.partitionBy("ticker").orderBy(F.abs(F.coalesce("my_weight", F.lit(0.0))).desc(), "driver", "source")
    return shares.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def search_index(edges: DataFrame, relation_origins: DataFrame, master: DataFrame) -> DataFrame:
    """(kind, name, industry): every industry, and every member once per industry."""
    mem = R.members(edges)
    ind = mem.select("industry").unionByName(relation_origins.select("industry")).distinct().select(
        F.lit("i").alias("kind"), F.col("industry").alias("name"), F.lit(None).cast("string").alias("industry"))
    stocks = mem.join(master.select("ticker", "name"), "ticker", "left").select(
        F.lit("s").alias("kind"), F.coalesce("name", "ticker").alias("name"), "industry").distinct()
    return ind.unionByName(stocks)


def kpi_row(candidates: DataFrame, ideas: DataFrame, gaps: DataFrame, edges: DataFrame,
            provenance: DataFrame) -> DataFrame:
    """The numbers on top of the daily report (each input shrinks to one row)."""
    one = [candidates.agg(F.count("*").alias("n_candidates")), ideas.agg(F.count("*").alias("n_ideas")),
           gaps.agg(F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(0.0)).alias("max_gap"),
                    F.countDistinct("grp").alias("n_groups")),
           edges.agg(F.count("*").alias("n_edges")),
           provenance.agg(F.count_if("graph_backed").alias("graph_backed"), F.count("*").alias("n_marked"))]
    return reduce(lambda a, b: a.join(F.broadcast(b)), one)


def coverage_holes(map_rows: DataFrame, resolved: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(kind, origin, name): names on maps without a ticker, and names nobody could match."""
    missing = map_rows.join(resolved.where(F.col("ticker").isNull()).select("company"), "company", "left_semi")
    return missing.select(F.lit("map").alias("kind"), F.col("map_file").alias("origin"),
                          F.col("company").alias("name")).unionByName(
        unmatched.select(F.lit("analysis").alias("kind"), F.col("shape").alias("origin"), "name")).distinct()


# ---- neighbourhood text -------------------------------------------------------------------

def _told(pattern: str, value: Column) -> Column:
    """A formatted number; nothing where there is none (format_string would spell out the NULL)."""
    return F.when(value.isNotNull(), F.format_string(pattern, value)).otherwise("")


def _leaders(members: DataFrame, key: list[str], master: DataFrame, gaps: DataFrame, limit: int) -> DataFrame:
    """(key, leaders, n): the largest members 'name(ticker) 갭+1.2%' of each key, one more than shown, and how many there are."""
    top = members_by_cap(members, master, key, limit + 1).join(gaps.select("ticker", "gap"), "ticker", "left")
    label = F.concat(F.coalesce(F.concat("name", F.lit("("), "ticker", F.lit(")")), "ticker"),
                     _told(" 갭%+.1f%%", F.col("gap") * 100))
    return top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "ticker", label.alias("t")))).alias("leaders"),
                                 (F.max("others") + F.count("*")).alias("n"))


def _names(limit: int, without: Column | None = None, own: Column | int = 0) -> Column:
    """Text of the leaders, ``without`` the asking ticker, which is ``own`` of the n members."""
    shown = F.col("leaders") if without is None else F.filter("leaders", lambda x: x["ticker"] != without)
    more = F.greatest(F.col("n") - own - limit, F.lit(0))
    return F.concat(F.array_join(F.transform(F.slice(shown, 1, limit), lambda x: x["t"]), ", "), F.when(
        more > 0, F.concat(F.lit(" 외 "), more.cast("string"), F.lit("종목"))).otherwise(""))


def context_lines(edges: DataFrame, tickers: DataFrame, master: DataFrame, best: DataFrame,
                  cfg: S.GraphSettings = CFG) -> DataFrame:
    """(ticker, part, key, line): lines of the neighbourhood text, in reading order of (part, key).

    Any number of tickers may ask: the leaders of an industry, or of one side of a driver, are found
    once, and an asking ticker meets them per membership, never the other members.
    """
    mem = R.members(edges, cfg.min_confidence)
    mine = mem.join(tickers.select("ticker"), "ticker", "left_semi")
    own = mine.groupBy("ticker").agg(F.sort_array(F.collect_set("industry")).alias("inds"))
    head = tickers.select("ticker").join(own, "ticker", "left").select(
        "ticker", F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.lit("### 소속 산업: "), F.coalesce(
            F.array_join("inds", ", "), F.lit("미분류 (밸류체인 맵에 없는 종목)"))).alias("line"))
    leaders = _leaders(mem, ["industry"], master, best, cfg.max_members)
    peer_lines = mine.join(leaders.where("n > 1"), "industry").select(
        "ticker", F.lit(1).alias("part"), F.col("industry").alias("key"),
        F.concat(F.lit("**동종 — "), "industry", F.lit("** "), _names(cfg.max_members, F.col("ticker"), 1)).alias("line"))
    parts = [head, peer_lines]
    for part, rel in ((2, S.REL_UPSTREAM), (3, S.REL_DOWNSTREAM)):
        j = R.vertical(edges, tickers, rel, cfg.min_confidence).join(
            leaders.select("industry", _names(cfg.max_members).alias("names")), "industry", "left")
        parts.append(j.select(
            "ticker", F.lit(part).alias("part"),
            F.concat(F.format_string("%.3f", 1.0 - F.col("confidence")), F.lit("|"), "from_industry", F.lit("|"),
                     "industry").alias("key"),
            F.concat(F.lit(f"- {rel} "), "industry", F.format_string(" [신뢰 %.2f, ", "confidence"), "sources",
                     F.lit("] "), F.coalesce("names", F.lit("(상장 종목 미상)"))).alias("line")))
    ex = R.exposed(edges, cfg.min_confidence)
    drv = drivers_by_weight(Q.driver_shares(edges, cfg.min_confidence).join(tickers.select("ticker"), "ticker", "left_semi"),
                            cfg.max_drivers)
    sided = ex.select("ticker", "driver", (F.col("sign") >= 0).alias("same")).where("same is not null").distinct()
    sides = _leaders(sided, ["driver", "same"], master, best, cfg.max_members)
    asked = drv.join(sides, "driver").join(sided.withColumn("own", F.lit(1)), ["ticker", "driver", "same"], "left").withColumn(
        "own", F.coalesce("own", F.lit(0))).where(F.col("n") > F.col("own"))
    parts.append(asked.select(
        "ticker", F.lit(4).alias("part"),
        F.concat(F.lpad(F.col("rank").cast("string"), 3, "0"), F.when(F.col("same"), "a").otherwise("b")).alias("key"),
        F.concat(F.lit("- "), "driver", F.format_string(" 부호 %+d", "my_sign"), _told(" β%+.2f", F.col("my_weight")),
                 F.when(F.col("same"), " 같은 방향: ").otherwise(" 반대 방향: "),
                 _names(cfg.max_members, F.col("ticker"), F.col("own"))).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def horizontal_lines(membership: DataFrame, gaps: DataFrame, peers: DataFrame, exposures: DataFrame,
                     master: DataFrame) -> DataFrame:
    """Lines about groups, lagging peers and factor exposures, for the tickers in ``membership``.

    ``peers`` is the group-peer table, ``exposures`` the ranked exposure table.
    """
    move = gaps.groupBy("grp").agg(F.max("group_move").alias("mv"))
    g = membership.join(move, "grp").select(
        "ticker", F.lit(5).alias("part"), F.col("grp").alias("key"),
        F.concat(F.lit("- "), "grp", _told(" — 그룹 최근 5일 %+.1f%%", F.col("mv") * 100)).alias("line"))
    p = peers.join(master.select("ticker", "name"), "ticker", "left").select(
        F.col("of").alias("ticker"), F.lit(5).alias("part"),
        F.concat("grp", F.lit("|"), F.lpad(F.col("rank").cast("string"), 3, "0")).alias("key"),
        F.concat(F.lit("    · "), F.coalesce("name", "ticker"), F.lit("("), "ticker", F.format_string(
            ") 갭 %+.1f%%", F.col("gap") * 100), F.when(F.col("unreacted"), "  ← 미반영").otherwise("")).alias("line"))
    e = exposures.join(membership.select("ticker").distinct(), "ticker", "left_semi").select(
        "ticker", F.lit(6).alias("part"), F.lpad(F.col("rank").cast("string"), 3, "0").alias("key"),
        F.concat(F.lit("- "), "factor", F.format_string(": β %+.2f (상관 %+.2f)", "beta", "corr"),
                                   _told(" / 팩터 최근 5일 %+.1f%%", F.col("ret5") * 100)).alias("line"))
    return reduce(DataFrame.unionByName, [g, p, e])


def context_text(lines: DataFrame) -> DataFrame:
    """One text per analysed ticker; its lines are bounded by the display limits."""
    return lines.groupBy("ticker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("part", "key", "line"))), lambda x: x["line"]), "\n").alias("text"))
