import dataclasses
import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.plans import daily

N, DAYS = 24, 140
AS_OF = "2024-07-01"


@pytest.fixture(scope="module")
def inputs(spark):
    """24 companies in three industries; the last industry follows the first five days later."""
    rng = np.random.default_rng(2)
    mkt = rng.normal(0, 0.008, DAYS)
    lead = rng.normal(0, 0.02, DAYS)
    drive = [lead, rng.normal(0, 0.02, DAYS), np.r_[np.zeros(5), lead[:-5]]]
    rets = np.column_stack([mkt + drive[j // 8] + rng.normal(0, 0.004, DAYS) for j in range(N)])
    rets[-5:, 8:12] += 0.05             # four builders rally
    close = 1000 * np.cumprod(1 + rets, axis=0)
    end = dt.date(2024, 7, 1)
    rows = [(end - dt.timedelta(days=DAYS - 1 - d), f"{j:05d}0", f"회사{j}", "KOSPI", float(close[d, j]), 1e6, 1e10,
             int(1e12) + j) for d in range(DAYS) for j in range(N)]
    snaps = spark.createDataFrame(rows, "base_date date, ticker string, name string, market string, close double, "
                                        "volume double, value double, market_cap long")
    ind = ["조선", "건설", "기자재"]
    maps = [("m.yaml", ind[j // 8], "peers", None, f"회사{j}") for j in range(N)]
    maps += [("m.yaml", "조선", "upstream", "기자재", "없는회사"), ("_x.yaml", "무시", "peers", None, "회사1")]
    fx = [(r[0], "A00001", "미국달러선물", float(500 * (1 + 0.01 * np.sin(i)))) for i, r in enumerate(rows[::N])]
    return daily.Inputs(
        snapshots=snaps, maps=spark.createDataFrame(
            maps, "map_file string, industry string, block string, segment string, company string"),
        etf_snapshots=spark.createDataFrame(fx, "base_date date, ticker string, name string, close double"),
        factor_specs=spark.createDataFrame([("달러", ["미국달러선물"], ["인버스"])],
                                           "factor string, keywords array<string>, exclude array<string>"),
        contracts=spark.createDataFrame([("1", "공급계약", "20240601", "회사0", "000000", "계약금액 5,000,000,000\n계약상대 회사9")],
                                        "rcept_no string, report_nm string, rcept_dt string, corp_name string, "
                                        "stock_code string, text string"))


def test_daily_run_end_to_end(spark, inputs, tmp_path):
    out = daily.run_daily(inputs, AS_OF)
    assert out["panel"].agg(F.max("n_days")).first()[0] == 130
    assert out["universe"].count() == N and 0 < out["candidates"].count() <= 30
    graph = {(r["src"], r["dst"], r["rel"]) for r in out["graph"].collect()}
    assert ("I:조선", "I:기자재", S.REL_UPSTREAM) in graph and ("I:기자재", "I:조선", S.REL_DOWNSTREAM) in graph
    assert ("T:000000", "T:000090", S.REL_DOWNSTREAM) in graph and not any("무시" in x for e in graph for x in e)
    lag = {(r["src"], r["dst"]): r["price_lag"] for r in out["scored_edges"].where("price_lag is not null").collect()}
    assert lag == {("I:조선", "I:기자재"): 5, ("I:기자재", "I:조선"): -5}
    assert out["scored_edges"].count() == out["persistent_edges"].count()
    assert out["contexts"].count() == min(20, out["candidates"].count())
    assert all(r["text"].startswith("### 소속 산업") for r in out["contexts"].collect())
    daily.save_run(out, str(tmp_path), AS_OF)
    daily.save_run({"candidates": out["candidates"]}, str(tmp_path), "2024-07-02")
    dates = spark.read.parquet(f"{tmp_path}/candidates").groupBy("base_date").count().collect()
    assert len(dates) == 2 and len({r["count"] for r in dates}) == 1


def test_slow_run_measures_the_same_pairs(inputs):
    cfg = S.Settings(lags=S.LagSettings(block_days=2, min_obs_blocks=24, max_lag_blocks=6))
    rows = daily.run_cycle_lags(inputs, AS_OF, cfg).collect()
    assert {(r["a"], r["b"]) for r in rows} == {("조선", "기자재"), ("기자재", "조선")}
    assert rows[0]["lag"] == -rows[1]["lag"] and rows[0]["overlap"] == 0.0


def test_persistent_edges_from_all_evidence(spark):
    master = spark.createDataFrame(
        [("000010", "가나조선", 9), ("000015", "가나조선우", 1), ("000020", "다라철강", 5), ("000030", "마바건설", 3)],
        "ticker string, name string, market_cap long")
    item = "ticker string, side string, pos int, industry string, share double, tier string, what string, segment string, quote string"
    inputs = daily.Inputs(
        snapshots=master,
        maps=spark.createDataFrame([("m.yaml", "조선", "peers", None, "가나조선"), ("m.yaml", "조선", "upstream", "철강", "다라철강")],
                                   "map_file string, industry string, block string, segment string, company string"),
        profiles=spark.createDataFrame([("000030", "suppliers", "다라철강", "아파트", "handbook")],
                                       "ticker string, side string, other_name string, products string, source string"),
        extractions=spark.createDataFrame([
            ("000010", "products", 0, "조선업계", 0.9, "A", "컨테이너선", "", "컨테이너선 매출 90%"),
            ("000010", "upstream", 0, "철강 산업", None, "B", "다라철강 후판", "", "후판은 다라철강에서 산다"),
            ("000010", "downstream", 0, "해운", None, "B", "해운사", "", "지어낸 문장은 원문에 없다")], item),
        sections=spark.createDataFrame([("000010", "컨테이너선 매출 90%.\n후판은 다라철강에서\n산다.", "사업보고서", "20240301")],
                                       "ticker string, text string, report_nm string, rcept_dt string"),
        persistent=spark.createDataFrame(
            [("T:000030", "I:건설", S.REL_MEMBER, 0, None, "dart", "000030", 0.7, "", "20230101", "", ""),
             ("T:000030", "D:유가", S.REL_EXPOSURE, 1, 0.5, "factor_beta", "", 0.4, "", "20230101", "", "")], daily.R.EDGE_SCHEMA))
    rows = {(r["src"], r["dst"], r["source"]): r for r in daily.build_persistent(inputs, master, "20240701").collect()}
    assert rows[("T:000010", "I:조선", "dart")]["weight"] == 0.9
    assert rows[("I:조선", "I:철강", "dart")]["evidence"] == "사업보고서(20240301): 후판은 다라철강에서 산다"
    assert rows[("I:철강", "I:조선", "valuechain")]["rel"] == S.REL_DOWNSTREAM
    assert ("T:000020", "T:000010", "dart") in rows and ("T:000020", "T:000030", "profile") in rows
    assert rows[("T:000015", "I:조선", "preferred")]["origin"] == "000010"
    assert rows[("T:000030", "I:건설", "dart")]["product"] == "아파트"
    assert not any("해운" in k[1] or k[2] == "factor_beta" for k in rows)


def test_runs_of_a_day_do_not_meet(spark, inputs):
    """A second run of the same day, fed with the first one's edges, leaves the first readable."""
    first = daily.run_daily(inputs, AS_OF)
    edges = first["persistent_edges"].count()
    again = daily.run_daily(dataclasses.replace(inputs, persistent=first["persistent_edges"]), AS_OF)
    assert again["persistent_edges"].count() == edges and first["persistent_edges"].count() == edges
    again.discard()
    assert first["graph"].count() > 0
    with pytest.raises(Exception):
        again["graph"].count()
    first.discard()


def test_daily_run_gates_and_rejects(spark, inputs):
    twice = inputs.snapshots.withColumn("pos", F.lit(1)).unionByName(
        inputs.snapshots.withColumns({"close": F.lit(1.0), "pos": F.lit(2)}))
    odd = spark.createDataFrame([("T:000000", "I:조선", "헛관계", 0, None, "dart", "", 0.5, "", "20230101", "", "")], daily.R.EDGE_SCHEMA)
    more = spark.createDataFrame([("2", "공급계약", "20240601", "회사0", "000000", "계약금액 5,000,000,000\n계약상대 외국상사")], inputs.contracts.schema)
    out = daily.run_daily(dataclasses.replace(inputs, snapshots=twice, persistent=odd, contracts=inputs.contracts.union(more)), AS_OF)
    assert out["panel"].count() == N * 130 and out["panel"].agg(F.min("close")).first()[0] > 1
    assert [r["company"] for r in out["rejects_unresolved_map_names"].collect()] == ["없는회사"]
    assert [r["rel"] for r in out["rejects_unknown_relations"].collect()] == ["헛관계"]
    assert [r["company"] for r in out["rejects_unlisted_buyers"].collect()] == ["외국상사"]
    assert out["rejects_orphan_preferred"].count() == 0
    asked = [r["pos"] for r in out["candidates"].orderBy("pos").collect()]
    assert asked == list(range(1, len(asked) + 1))
    with pytest.raises(Exception, match="trading days"):
        daily.run_daily(inputs, "2024-03-01", strict=True)


def test_rejects_of_filings(spark):
    master = spark.createDataFrame([("000010", "가나조선", 9), ("000025", "없는주우", 1)], "ticker string, name string, market_cap long")
    item = "ticker string, side string, pos int, industry string, share double, tier string, what string, segment string, quote string"
    inputs = daily.Inputs(
        snapshots=master,
        maps=spark.createDataFrame([("m.yaml", "조선", "peers", None, "가나조선")], "map_file string, industry string, block string, segment string, company string"),
        profiles=spark.createDataFrame([("000010", "suppliers", "모르는곳", "판", "handbook")], "ticker string, side string, other_name string, products string, source string"),
        extractions=spark.createDataFrame([("000010", "upstream", 0, "철강", None, "B", "외국제철 후판", "", "후판은 외국제철에서 산다"),
                                           ("000010", "downstream", 1, "해운", None, "B", "해운사", "", "지어낸 문장은 원문에 없다")], item),
        sections=spark.createDataFrame([("000010", "후판은 외국제철에서 산다.", "사업보고서", "20240301")], "ticker string, text string, report_nm string, rcept_dt string"))
    _, rejects = daily.persistent_tables(inputs, master, "20240701", daily.new_run("t"))
    assert [r["other_name"] for r in rejects["unresolved_profiles"].collect()] == ["모르는곳"]
    assert [r["industry"] for r in rejects["dropped_quotes"].collect()] == ["해운"]
    assert [tuple(r) for r in rejects["relations_without_products"].collect()] == [("000010", 1)]
    assert "외국제철" in {r["token"] for r in rejects["unlisted_counterparties"].collect()}
    assert [r["ticker"] for r in rejects["orphan_preferred"].collect()] == ["000025"]


def analysis(name, **other):
    told = {"cause_summary": "s", "cause_type": S.CAUSE_TYPES[0], "cause_scope": S.SCOPE_INDUSTRY, "industry": "조선", "evidence": "e",
            "confidence": "높음", "ripple_axis": "수직", "ripple_paths": [{
                "direction": "후방산업", "target_industry": "기자재", "logic": "l",
                "beneficiaries": [{"name": name, "impact": S.IMPACT_GAIN, "reason": "r"}]}]}
    return json.dumps(told | other, ensure_ascii=False)


def test_inference_report_and_scoring_follow_the_day(spark, inputs):
    day = daily.run_daily(inputs, AS_OF)
    asked = day["candidates"].where("pos <= 20").select("ticker")
    reach = {r["ticker"]: r["via"] for r in daily.R.reach_overall(day["reach"]).collect()}
    best = {r["ticker"]: r["gap"] for r in daily.X.best_gap(day["group_gaps"]).collect()}
    ben = lambda name, **more: {"name": name, "impact": S.IMPACT_GAIN, "priced_in": "미반영", "comment": "c"} | more
    idea = lambda *b: {"title": "t", "axis": "수직", "driver": "d", "path": "p", "watch_points": "w", "beneficiaries": list(b)}
    good = {"market_summary": "m", "ideas": [idea(ben("회사17"), ben("없는곳", gap=0.5), ben(None, ticker="000010")), idea()]}
    bad = {"market_summary": "m", "ideas": [idea(ben("회사1", priced_in="모름"))]}
    syntheses = spark.createDataFrame([("a", json.dumps(good)), ("b", json.dumps(bad)), ("c", json.dumps({"market_summary": "m", "ideas": []}))],
                                      "run string, payload string")
    analyses = spark.createDataFrame([("000000", analysis("회사16")), ("000010", analysis("회사3", cause_type="X")), ("000020", "[]"),
                                      ("000030", None)], "ticker string, payload string")
    out = daily.run_inference(day, analyses, syntheses, AS_OF)
    assert [r["ticker"] for r in out["analyses"].collect()] == ["000000"]
    assert {r["ticker"] for r in out["rejects_analyses"].collect()} == {"000010", "000020", "000030"}
    assert {r["run"] for r in out["rejects_syntheses"].collect()} == {"b"}
    assert {(r["shape"], r["matched"], r["total"]) for r in out["match_stats"].collect()} == {("analysis", 1, 1), ("synthesis", 1, 3)}
    cases = {r["run"]: r for r in out["cases"].collect()}
    assert set(cases) == {"a", "c"} and cases["c"]["synthesis"]["ideas"] == []
    first, second = cases["a"]["synthesis"]["ideas"]
    assert second["beneficiaries"] == [] and [b["name"] for b in first["beneficiaries"]] == ["회사17", "없는곳", None]
    known, lost, told = first["beneficiaries"]
    assert (known["ticker"], known["gap"], known["via"]) == ("000170", best.get("000170"), reach.get("000170"))
    assert known["graph_backed"] == ("000170" in reach) and (lost["ticker"], lost["gap"], lost["graph_backed"]) == (None, 0.5, None)
    assert (told["ticker"], told["graph_backed"]) == ("000010", "000010" in reach)
    assert asked.count() > 0 and reach

    report = daily.run_report(day, out, inputs.maps, AS_OF)
    assert [(r["supplier"], r["consumer"]) for r in report["flow"].collect()] == [("기자재", "조선")]
    assert {r["node"]: r["layer"] for r in report["layers"].collect()} == {"기자재": 0, "조선": 1}
    assert [(r["node"], r["below"]) for r in report["downstream"].collect()] == [("기자재", "조선")] and report["cycle_cuts"].count() == 0
    assert [(r["seed"], r["node"]) for r in report["supply_chains"].collect()] == [("조선", "기자재")]
    assert [(r["seed"], r["node"]) for r in report["demand_chains"].collect()] == [("기자재", "조선")]
    assert [(r["seller"], r["buyer"]) for r in report["trades"].collect()] == [("000000", "000090")]
    assert {(r["kind"], r["name"]) for r in report["coverage_holes"].collect()} >= {("map", "없는회사"), ("analysis", "없는곳")}
    kpis = report["kpis"].first()
    assert (kpis["n_ideas"], kpis["n_marked"], kpis["n_edges"]) == (2, 2, day["graph"].count())   # names that resolve
    assert {r["industry"]: r["n_members"] for r in report["industry_rank"].collect()} == {"조선": 8, "건설": 8, "기자재": 8}
    for name, table in report.items():
        table.collect()

    later = [(t, dt.date(2024, 7, 1) + dt.timedelta(days=i), 100.0 + i) for t in ("000170", "000010") for i in range(20)]
    scores = daily.run_scoring(out["cases"], spark.createDataFrame(later, "ticker string, day date, close double"), "2024-08-15")
    assert {(r["ticker"], round(r["forward_return"], 6)) for r in scores["scored"].collect()} == {("000170", 0.1), ("000010", 0.1)}
    for r in (scores, report, out, day):
        r.discard()
