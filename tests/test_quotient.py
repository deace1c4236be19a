"""Lookups over classes against the pairwise lookups, on graphs with planted twins and crowds."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import graph as R
from tideline.operators import quotient as Q
from tideline.operators import reports as T

M, U, D, E = S.RELATIONS


def edge(src, dst, rel, source="valuechain", origin="", conf=0.5, sign=0, weight=None):
    return (src, dst, rel, sign, weight, source, origin, conf, f"{src}>{dst}", "1", "", "")


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(11)
    rows = {}
    add = lambda e: rows.setdefault((e[0], e[1], e[2], e[5], e[6]), e)
    tickers = [f"{k:03d}" for k in range(60)]
    for k, t in enumerate(tickers):
        home = 0 if k % 3 == 0 else r.randrange(8)  # a third of all tickers in one industry, as twins
        add(edge(f"T:{t}", f"I:{home}", M))
        if k % 3 and r.random() < 0.4:
            add(edge(f"T:{t}", f"I:{r.randrange(8)}", M, "dart", t, 0.85))
        for d in range(5):
            if k % 3 and r.random() < 0.3:
                add(edge(f"T:{t}", f"D:{d}", E, r.choice(["factor_beta", "theme_index"]), sign=r.choice([1, -1]), weight=round(r.uniform(-1, 1), 2)))
    for _ in range(18):
        a, b = r.sample(range(10), 2)
        add(edge(f"I:{a}", f"I:{b}", U, r.choice(["valuechain", "dart"]), r.choice(["", "001"]), r.choice([0.5, 0.7])))
        add(edge(f"I:{b}", f"I:{a}", D))
    table = spark.createDataFrame(list(rows.values()), R.EDGE_SCHEMA).cache()
    everyone = spark.createDataFrame([(t, (7 * k) % 60) for k, t in enumerate(tickers)], "ticker string, pos int")
    return table, everyone, Q.classes(table).cache()


def test_twins_are_one_class(world):
    table, everyone, cls = world
    got = dict(map(tuple, cls.collect()))
    assert {got[f"{k:03d}"] for k in range(0, 60, 3)} == {"000"} and set(got) == {r.ticker for r in everyone.collect()}
    marks = defaultdict(set)
    for r in R.memberships(table).collect():
        marks[r.ticker].add((r.industry, r.confidence, r.source))
    for r in R.exposed(table).collect():
        marks[r.ticker].add(r.driver)
    assert all((got[a] == got[b]) == (marks[a] == marks[b]) for a in got for b in got)


def test_every_pair_has_the_label_of_the_pairwise_lookup(world):
    table, everyone, cls = world
    routes, targets = Q.routes(table, cls).cache(), Q.targets(table)
    want = R.reachability(table, everyone)
    pairs = everyone.select("ticker").crossJoin(everyone.select(F.col("ticker").alias("other")))
    got = {(r.ticker, r.other): r.via for r in Q.reach_of(routes, cls, targets, pairs).collect()}
    assert got == {(r.ticker, r.other): r.via for r in want.collect()} and len(got) > 1000
    overall = {r.ticker: r.via for r in Q.first_reach(routes, cls, targets, everyone).collect()}
    assert overall == {r.ticker: r.via for r in R.reach_overall(want).collect()}
    few = everyone.where("pos < 3")
    overall = {r.ticker: r.via for r in Q.first_reach(routes, cls, targets, few).collect()}
    assert overall == {r.ticker: r.via for r in R.reach_overall(R.reachability(table, few)).collect()}


def test_class_rows_stand_for_their_members(world):
    table, everyone, cls = world
    keys = ["from_industry", "industry", "relation", "confidence", "source", "sources"]
    both = R.vertical(table, everyone, U).unionByName(R.vertical(table, everyone, D)).select("ticker", *keys)
    by_class = Q.class_paths(table, cls).join(cls, "class_id").select("ticker", *keys)
    assert by_class.exceptAll(both).count() == both.exceptAll(by_class).count() == 0
    peers = R.peers(table, everyone).groupBy("ticker", "industry").agg((F.count("*") + 1).alias("n_members"))
    own = Q.class_industries(table, cls).join(cls, "class_id").where("n_members > 1").select("ticker", "industry", "n_members")
    assert own.exceptAll(peers).count() == peers.exceptAll(own).count() == 0
    shares = R.co_exposed(table, everyone).groupBy("ticker", "driver", "source", "my_sign", "my_weight").agg(
        F.count_if(F.col("sign") >= 0).alias("n_same"), F.count_if(F.col("sign") < 0).alias("n_opposite"))
    got = Q.driver_shares(table)
    assert got.exceptAll(shares).count() == shares.exceptAll(got).count() == 0 and got.count() > 30
    parts = {r.part: r.n for r in Q.neighbourhood(table, cls).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert set(parts) == {"member", "industry", "upstream", "downstream", "driver"} and parts["member"] == 60


def test_co_exposures_lose_no_pair(world):
    table, everyone, _ = world
    found = Q.co_exposures(table)
    share, member = found.where("part = 'share'"), found.where("part = 'member'")
    pairs = share.select("ticker", "driver", "my_sign", "my_weight", "source").join(
        member.select("driver", "other", "sign", "weight", "other_source"), "driver").where("other <> ticker")
    want = R.co_exposed(table, everyone)
    pairs = pairs.select(want.columns)
    assert pairs.exceptAll(want).count() == want.exceptAll(pairs).count() == 0 and want.count() > 30
    assert member.count() == R.exposed(table).count()


def test_lookups_grow_with_memberships(spark):
    """A crowded industry: no row per pair of members."""
    crowd = spark.range(3000).select(F.format_string("%05d", "id").alias("t"))
    e = R.edges(crowd, src=F.concat(F.lit("T:"), "t"), dst=F.lit("I:0"), rel=M, source="valuechain").drop("pos")
    more = R.edges(crowd, src=F.concat(F.lit("T:"), "t"), dst=F.lit("D:0"), rel=E, source="factor_beta", sign=1, weight=0.5).drop("pos")
    table = e.unionByName(more)
    cls = Q.classes(table)
    assert Q.neighbourhood(table, cls).count() == 3003 and Q.driver_shares(table).count() == 3000
    reach = Q.first_reach(Q.routes(table, cls), cls, Q.targets(table), crowd.select(F.col("t").alias("ticker"), F.col("t").cast("int").alias("pos")))
    assert reach.count() == 3000 and {r.via for r in reach.select("via").distinct().collect()} == {"0→" + S.PEER_LABEL}


def test_context_lines_of_everyone_leave_the_ticker_itself_out(spark, world):
    table, everyone, _ = world
    master = everyone.select("ticker", F.concat(F.lit("n"), "ticker").alias("name"), (100 - F.col("ticker").cast("int")).alias("market_cap"))
    gaps = spark.createDataFrame([("003", 0.0123)], "ticker string, gap double")
    lines = T.context_lines(table, everyone, master, gaps).collect()
    peers = {r.ticker: r.line for r in lines if r.part == 1 and r.key == "0"}
    members = sorted(r.ticker for r in R.members(table, S.GraphSettings().min_confidence).where("industry = '0'").collect())
    shown = S.GraphSettings().max_members
    for t, line in peers.items():
        others = [m for m in members if m != t]
        text = ", ".join(f"n{m}({m})" + (" 갭+1.2%" if m == "003" else "") for m in others[:shown])
        assert line == f"**동종 — 0** {text} 외 {len(others) - shown}종목"
    assert set(peers) == set(members)
    assert not any("n%" in r.line for r in lines if "갭" in r.line)
    one = T.context_lines(table, everyone.where("ticker = '001'"), master, gaps).collect()
    assert sorted(one) == sorted(r for r in lines if r.ticker == "001")
