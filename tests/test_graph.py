import pytest
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import chains as Ch
from tideline.operators import graph as R
from tideline.operators import names as NM
from tideline.operators import reports as T


def edge(src, dst, rel, source="valuechain", origin="", conf=0.5, asof="1", product="", sign=0, weight=None,
         evidence="", attribution=""):
    return (src, dst, rel, sign, weight, source, origin, conf, evidence, asof, product, attribution)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), R.EDGE_SCHEMA)


@pytest.fixture(scope="module")
def graph(spark):
    M, U, D, E = S.RELATIONS
    return table(
        spark, edge("T:a", "I:ship", M), edge("T:a", "I:ship", M, "dart", "a", 0.85), edge("T:b", "I:ship", M),
        edge("T:c", "I:steel", M), edge("T:d", "I:steel", M), edge("I:ship", "I:steel", U, evidence="map"),
        edge("I:ship", "I:steel", U, "dart", "a", 0.7, evidence="filing"), edge("I:steel", "I:ship", D),
        edge("T:a", "D:oil", E, "factor_beta", sign=1, weight=0.5), edge("T:c", "D:oil", E, "factor_beta", sign=-1,
                                                                         weight=-0.4))


def test_merge_newest_wins_and_origins_stay_apart(spark):
    a = table(spark, edge("T:a", "I:x", S.REL_MEMBER, asof="2", product="old"),
              edge("T:a", "I:x", S.REL_MEMBER, "dart", "a"), edge("T:a", "I:x", S.REL_MEMBER, "dart", "b"))
    b = table(spark, edge("T:a", "I:x", S.REL_MEMBER, asof="2", product="new"),
              edge("T:a", "I:x", S.REL_MEMBER, "dart", "a", asof="0", product="stale"))
    got = {(r["source"], r["origin"]): r["product"] for r in R.merge(a, b).collect()}
    assert got == {("valuechain", ""): "new", ("dart", "a"): "", ("dart", "b"): ""}


def test_unknown_relation_is_rejected(spark):
    ok, bad = R.known_relations(table(spark, edge("T:a", "I:x", S.REL_MEMBER), edge("T:a", "I:x", "friend")))
    assert ok.count() == 1 and bad.first()["rel"] == "friend"


def test_two_hop_lookup_merges_paths(spark, graph):
    asked = spark.createDataFrame([("a", 1)], "ticker string, pos int")
    v = R.vertical(graph, asked, S.REL_UPSTREAM).collect()
    assert len(v) == 1 and v[0]["confidence"] == 0.595 and v[0]["sources"] == "dart+valuechain"
    assert v[0]["evidence"] == "filing"
    reach = {r["other"]: r["via"] for r in R.reachability(graph, asked).collect()}
    assert reach == {"c": "ship→후방→steel", "d": "ship→후방→steel", "b": "ship→동종"}
    co = R.co_exposed(graph, asked).first()
    assert (co["other"], co["my_sign"], co["sign"]) == ("c", 1, -1)
    assert {(r["part"], r["other"]) for r in R.subgraph(graph, asked).collect()} == {
        ("industry", None), ("peer", "b"), ("upstream", "c"), ("upstream", "d"), ("driver", "c")}


def test_preferred_share_inherits_and_orphans_are_listed(spark):
    e = table(spark, edge("T:005930", "I:chips", S.REL_MEMBER, "dart", "005930", 0.85, product="dram"))
    m = spark.createDataFrame([("005930", "삼성전자"), ("005935", "삼성전자우"), ("00680K", "미래2우B"), ("000660", "우리")],
                              "ticker string, name string")
    got, orphans = R.inherit_preferred(e, m, "1")
    row = got.first()
    assert (row["src"], row["origin"], row["confidence"], row["product"]) == ("T:005935", "005930", 0.85, "dram")
    assert got.count() == 1 and [r["ticker"] for r in orphans.collect()] == ["00680K"]


def test_names_resolve_exactly_or_not_at_all(spark):
    m = spark.createDataFrame([("1A0000", "한화", 5), ("100001", "한화솔루션", 9), ("100002", "LIG넥스원", 1),
                               ("100003", "동명", 1), ("100004", "동명", 7)], "ticker string, name string, market_cap long")
    idx = NM.name_index(m)
    asked = spark.createDataFrame([("㈜ 한화",), ("ＬＩＧ 넥스원",), ("한화솔",), ("옛이름(100001)",), ("한화(999999)",),
                                   ("동명",)], "company string")
    got = {r["company"]: r["ticker"] for r in NM.resolve(asked, m, idx).collect()}
    assert got == {"㈜ 한화": "1A0000", "ＬＩＧ 넥스원": "100002", "한화솔": None, "옛이름(100001)": "100001",
                   "한화(999999)": None, "동명": "100004"}
    assert {r["ticker"] for r in NM.name_collisions(m, idx).collect()} == {"100003", "100004"}


def test_near_misses_equal_brute_force(spark):
    names = ["HD현대미포", "현대미포조선", "현대차", "미포", "한화오션", "한화", "세메스", "HD현대중공업"]
    m = spark.createDataFrame([(f"{i:06d}", n, 1) for i, n in enumerate(names)], "ticker string, name string, market_cap long")
    asked = ["현대미포", "한화엔진", "오션", "중공"]

    def lcs(a, b):
        return max((k for i in range(len(a)) for k in range(1, len(a) - i + 1) if a[i:i + k] in b), default=0)

    want = {}
    for q in asked:
        hits = [(q not in n and n not in q, -lcs(q, n), abs(len(n) - len(q)), n) for n in names
                if n != q and lcs(q, n) >= max(2, min(len(q), 4) - 1)]
        want[q] = [h[-1] for h in sorted(hits)[:3]]
    got = {q: [] for q in asked}
    df = NM.near_misses(spark.createDataFrame([(q,) for q in asked], "company string"), NM.name_index(m))
    for r in df.orderBy("company", "rank").collect():
        got[r["company"]].append(r["norm_name"])
    assert got == want


def test_industry_suffixes_peel_one_by_one(spark):
    from tideline.functions.names import normalize_industry
    cases = {"시멘트 제조업": "시멘트", "반도체·장비 산업부문": "반도체장비", "A사업부문": "A사업부문", "산업": "산업", "건설산업산업": "건설"}
    df = spark.createDataFrame(list(cases.items()), "n string, want string")
    for r in df.withColumn("got", normalize_industry(F.col("n"))).collect():
        assert r["got"] == r["want"], r


def test_new_industry_stands_for_its_later_spellings(spark):
    said = spark.createDataFrame([("로봇 산업", 2), ("로봇", 5), ("강재", 1), ("철강 제조업", 3)], "name string, pos int")
    vocab = spark.createDataFrame([("철강",)], "industry string")
    alias = spark.createDataFrame([("강재", "철강")], "alias string, target string")
    got = {r["name"]: (r["industry"], r["is_new"]) for r in NM.resolve_industries(said, vocab, alias).collect()}
    assert got == {"로봇 산업": ("로봇 산업", True), "로봇": ("로봇 산업", True), "강재": ("철강", False), "철강 제조업": ("철강", False)}


# ---- flow graph ---------------------------------------------------------------------------

def flows(spark, pairs):
    return spark.createDataFrame(pairs, "supplier string, consumer string")


def drop_by_hand(pairs):
    live, out = set(pairs), set()
    while live:
        nodes = {n for p in live for n in p}
        ends = {n for n in nodes if not any(a == n for a, _ in live) or not any(b == n for _, b in live)}
        if not ends:
            pick = min(nodes, key=lambda n: (sum(b == n for _, b in live) - sum(a == n for a, _ in live), n))
            out |= {p for p in live if p[1] == pick}
            ends = {pick}
        live = {p for p in live if not ends & set(p)}
    return out


def test_cycles_break_and_layers_follow(spark):
    pairs = [("ore", "steel"), ("steel", "machine"), ("machine", "ore"), ("steel", "ship"), ("ship", "line"),
             ("coal", "ship"), ("machine", "coal"), ("line", "ship"), ("seed", "food")]
    kept, dropped = Ch.break_cycles(flows(spark, pairs))
    assert {tuple(r) for r in dropped.collect()} == drop_by_hand(pairs)
    rest = [tuple(r) for r in kept.collect()]
    layer = {r["node"]: r["layer"] for r in Ch.layers(kept).collect()}
    assert all(layer[a] < layer[b] for a, b in rest) and min(layer.values()) == 0
    below = {}
    for a, b in rest:
        below.setdefault(a, set()).add(b)
    changed = True
    while changed:
        changed = False
        for a in below:
            more = set().union(*(below.get(b, set()) for b in below[a])) - below[a]
            changed |= bool(more)
            below[a] |= more
    assert {(r["node"], r["below"]) for r in Ch.closure(kept).collect()} == {(a, b) for a in below for b in below[a]}


def test_closure_of_long_and_cyclic_flows(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)]
    got = {(r["node"], r["below"]) for r in Ch.closure(flows(spark, chain)).collect()}
    assert got == {(f"n{i:02d}", f"n{j:02d}") for i in range(21) for j in range(i + 1, 21)}
    ring = Ch.closure(flows(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])).collect()
    assert sorted((r["node"], r["below"]) for r in ring) == [(x, y) for x in "abc" for y in "abcd"]
    assert Ch.closure(flows(spark, chain).limit(0)).count() == 0


def test_chain_levels_never_repeat_and_respect_caps(spark):
    adj = spark.createDataFrame([("s", f"x{i}", 10 - i) for i in range(7)] + [("x0", "s", 9), ("x0", "x6", 1),
                                ("x1", "y", 5), ("y", "x0", 3)], "node string, target string, n_origins int")
    rows = Ch.chain_levels(spark.createDataFrame([("s",)], "industry string"), adj).orderBy("level", "rank").collect()
    assert [(r["level"], r["node"]) for r in rows] == [(1, f"x{i}") for i in range(5)] + [(2, "x6"), (2, "y")]


def test_flow_label_prefers_goods(spark):
    M, U, D, E = S.RELATIONS
    say = lambda p: edge("I:건설", "I:시멘트", U, "dart", p, product=p)
    e = table(spark, say("레미콘(유진기업) / 벌크시멘트(한일)"), say("국내 건설 산업"), say("토목"))
    assert Ch.flow_labels(e).first()["label"] == "레미콘 / 벌크시멘트"
    f = Ch.flow_edges(e).first()
    assert (f["supplier"], f["consumer"], f["n_origins"], f["guessed"]) == ("시멘트", "건설", 3, False)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_normalized_after_they_are_made_distinct(spark):
    """A filter on what was found must not bring the normalization ahead of the distinct, to every row."""
    names = spark.createDataFrame([("Ａ Corp",), ("A Corp",), ("A Corp",), ("x(000001)",), (None,)], "company string")
    master = spark.createDataFrame([("000001", "A Corp", 5)], "ticker string, name string, market_cap long")
    found = NM.resolve(names, master, NM.name_index(master))
    rows = names.join(found, "company", "left").where("ticker is not null")
    assert sorted(r["company"] for r in rows.collect()) == ["A Corp", "A Corp", "x(000001)", "Ａ Corp"]
    asked = [line for line in _plan(found.where("ticker is not null")).split("\n") if "pythonUDF" not in line or "ArrowEvalPython" in line]
    depth = {kind: [len(line) - len(line.lstrip(" :+-")) for line in asked if line.lstrip(" :+-").startswith(kind)] for kind in ("ArrowEvalPython", "HashAggregate(keys=[company")}
    assert min(depth["HashAggregate(keys=[company"]) > min(depth["ArrowEvalPython"])


def test_trades_are_dealt_out_once_for_merge_and_rollup(spark):
    rows = [("T:1", "T:2", "a", "one", 0.1), ("T:1", "T:2", "a", "other", None), ("T:1", "T:2", "b", "longer", 0.3), ("T:2", "T:1", "a", "", None)]
    t = spark.createDataFrame(rows, "s string, d string, o string, p string, w double")
    e = R.edges(t, src=F.col("s"), dst=F.col("d"), rel=S.REL_DOWNSTREAM, source="dart", origin=F.col("o"), product=F.col("p"), weight=F.col("w"), pos=F.col("p"))
    want = T.trade_rollup(R.merge(e))
    got = T.trade_rollup(R.merge(e, columns=(*R.KEY, "product", "weight"), by=("src", "dst")))
    assert _plan(got).count("Exchange hashpartitioning") == 1 and _plan(want).count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("1", "2", "longer", 0.3), ("2", "1", "", None)]
