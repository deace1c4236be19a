import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import inference as V
from tideline.operators import scoring as K
from tideline.sources import records as J

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def prices(spark, rows):
    return spark.createDataFrame(rows, "ticker string, day date, close double")


def test_forward_return_counts_traded_rows_and_never_shortens(spark):
    rows = [("a", day(i), 100.0 + i) for i in range(0, 20)] + [("b", day(i), 10.0) for i in range(0, 4)]
    rows += [("c", day(0), 5.0), ("c", day(1), 0.0), ("c", day(2), 6.0), ("c", day(40), 7.0)]
    keys = spark.createDataFrame([("a", day(3)), ("a", day(18)), ("b", day(0)), ("c", day(0)), ("a", day(-2)), ("c", day(1))],
                                 "ticker string, base_date date")
    got = {(r["ticker"], r["base_date"]): r["forward_return"]
           for r in K.forward_returns(keys, prices(spark, rows), 5).collect()}
    assert got == {("a", day(3)): pytest.approx(108 / 103 - 1), ("a", day(-2)): pytest.approx(1.05 - 1)}
    one = {(r["ticker"], r["base_date"]): r["forward_return"]
           for r in K.forward_returns(keys, prices(spark, rows), 1).collect()}
    assert one[("c", day(0))] == pytest.approx(0.2) and ("c", day(1)) not in one and ("a", day(18)) in one


def scored(spark):
    rows = [(S.IMPACT_GAIN, "미반영", "수직", True, "p", 0.1 * i, 0.01 * i) for i in range(-1, 4)]
    rows += [(S.IMPACT_LOSS, "기반영", "수평", False, "q", -0.2, None), (S.IMPACT_LOSS, None, "수평", None, "q", 0.3, None)]
    return spark.createDataFrame(
        [(DAY, "i", x[2], "n", "t", x[0], x[1], x[6], x[3], x[4], x[5]) for x in rows],
        "base_date date, idea string, axis string, name string, ticker string, impact string, priced_in string, gap double, "
        "graph_backed boolean, via string, forward_return double")


def test_summary_groups_and_small_paths(spark):
    got = {(r["dim"], r["value"]): r for r in K.summary(scored(spark)).collect()}
    assert got[("overall", "")]["n"] == 7 and got[("overall", "")]["median"] == pytest.approx(0.1)
    assert got[("path", "p")]["hit_rate"] == pytest.approx(0.6) and ("path", "q") not in got
    assert got[("provenance", S.PROVENANCE_MODEL)]["n"] == 1 and ("priced_in", "일부반영") not in got


def test_directional_hits_and_gap_check(spark):
    assert K.directional_hit_rate(scored(spark)).first()["directional_hit_rate"] == pytest.approx(4 / 7)
    g = K.gap_validity(scored(spark)).first()
    assert (g["n"], g["top_n"]) == (5, 1) and g["corr"] == pytest.approx(1.0) and g["top_mean"] == pytest.approx(0.3)
    assert K.gap_validity(scored(spark).limit(4)).count() == 0


def case(name, ticker, **more):
    ben = {"name": name, "ticker": ticker, **more}
    return {"synthesis": {"market_summary": "m", "ideas": [{"title": "t", "axis": "수직", "beneficiaries": [ben]}]}}


def test_case_files_age_ticker_and_torn_files(spark, tmp_path):
    for name, doc in (("20240101", json.dumps(case("가", "000001"))), ("20240102", json.dumps(case("나", None))),
                      ("20240120", json.dumps(case("다", "000003"))), ("20240103", '{"synthesis": {"ideas": ['),
                      ("19990101", json.dumps(case("라", "000004"))), ("20249999", json.dumps(case("마", "000005")))):
        (tmp_path / f"{name}.json").write_text(doc, encoding="utf-8")
    p = K.aged_predictions(J.load_cases(spark, str(tmp_path))[0], "2024-01-30", K.min_age_days(5))
    assert [(r["ticker"], r["impact"], r["base_date"]) for r in p.collect()] == [("000001", S.IMPACT_GAIN, DAY)]


ANALYSIS = {"cause_summary": "s", "cause_type": "테마·수급", "cause_scope": "산업공통", "industry": "i", "evidence": "e",
            "confidence": "높음", "ripple_axis": "수직",
            "ripple_paths": [{"direction": "전방산업", "target_industry": "x", "logic": "l",
                              "beneficiaries": [{"name": "가", "impact": "수혜", "reason": "r"}]}]}


def test_one_bad_analysis_does_not_take_the_others(spark):
    import copy
    bad = {k: copy.deepcopy(ANALYSIS) for k in ("missing", "enum", "nullenum", "way", "impact", "scope")}
    del bad["missing"]["evidence"]
    bad["enum"]["confidence"] = "매우"
    bad["nullenum"]["cause_type"] = None
    bad["way"]["ripple_paths"][0]["direction"] = "옆"
    bad["impact"]["ripple_paths"][0]["beneficiaries"].append({"name": "나", "impact": "중립"})
    bad["scope"]["cause_scope"] = S.SCOPE_COMPANY
    fine = copy.deepcopy(ANALYSIS)
    fine["ripple_paths"] = []
    fine["cause_scope"] = S.SCOPE_COMPANY
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in {**bad, "ok": ANALYSIS, "own": fine}.items()]
    v = V.validate_analyses(spark.createDataFrame(rows + [("junk", "[1]")], "ticker string, payload string"))
    counts = {r["ticker"]: len(r["problems"]) for r in v.collect()}
    assert counts == {**{k: 1 for k in bad}, "junk": 1, "ok": 0, "own": 0}
    assert {r["ticker"] for r in V.industry_wide(V.usable(v)).collect()} == {"ok"}
    assert [(r["name"], r["impact"]) for r in V.analysis_beneficiaries(V.usable(v)).collect()] == [("가", "수혜")]


def test_priced_in_and_provenance(spark):
    b = spark.createDataFrame([("analysis", "1", "가", "수혜"), ("analysis", "1", "없음", "수혜")],
                              "shape string, origin string, name string, impact string")
    res = spark.createDataFrame([("가", "000001"), ("없음", None)], "company string, ticker string")
    rets = spark.createDataFrame([("000001", 0.1, 0.2)], "ticker string, ret5 double, ret20 double")
    best = spark.createDataFrame([("000001", "g", 0.05, 1.1)], "ticker string, grp string, gap double, beta double")
    a = V.annotate_priced_in(b, res, rets, best)
    hit = a.where("ticker is not null").first()
    assert (hit["ret5"], hit["gap"], hit["gap_group"]) == (0.1, 0.05, "g")
    assert V.match_stats(a).first()["matched"] == 1 and V.unmatched_names(a).first()["name"] == "없음"
    m = V.with_provenance(a, spark.createDataFrame([("000001", "x→동종")], "ticker string, via string")).collect()
    assert len(m) == 1 and m[0]["graph_backed"] and m[0]["via"] == "x→동종"


def test_edge_lines_round_trip_and_skip_torn_lines(spark, tmp_path):
    from tideline.operators import graph as R
    row = ("T:a", "I:x", S.REL_MEMBER, 0, None, "dart", "a", 0.85, "인용", "1", "물건", "")
    e = spark.createDataFrame([row], R.EDGE_SCHEMA)
    path = str(tmp_path / "edges")
    J.write_edges(e, path)
    (tmp_path / "edges" / "torn.txt").write_text('{"src": "T:b", \n', encoding="utf-8")
    assert [tuple(r) for r in J.read_edges(spark, path).select(*R.EDGE_COLUMNS).collect()] == [row]


def test_coverage_targets_order_and_counts(spark):
    from tideline.operators import disclosures as X
    t = lambda *xs: spark.createDataFrame([(x,) for x in xs], "ticker string")
    u = spark.createDataFrame([("1", "가", 5), ("2", "나우B", 9), ("3", "다증권", 9), ("4", "라", 1), ("5", "마", 8), ("6", "바", 3)],
                              "ticker string, name string, market_cap long")
    got = X.coverage_targets(u, t("5"), t("6"), t("4"), 10)
    assert [r["ticker"] for r in got.collect()] == ["4", "1"]
    assert {r["state"]: r["n"] for r in X.coverage_counts(u, t("5"), t("6")).collect()} == {
        "todo": 2, "preferred": 1, "no_chain": 1, "mapped": 1, "pending": 1}


def test_elements_of_a_wrong_type_are_problems(spark):
    good = dict.fromkeys(S.CAUSE_TYPES_REQUIRED, "x") | {
        "cause_type": S.CAUSE_TYPES[0], "cause_scope": S.SCOPE_INDUSTRY, "confidence": S.CONFIDENCE_LEVELS[0], "ripple_axis": S.RIPPLE_AXES[0]}
    path = {"direction": S.DIRECTIONS[0], "beneficiaries": [{"name": "n", "impact": S.IMPACT_GAIN}]}
    cases = {"ok": [path], "text": ["x", path], "null": [None], "ben": [path | {"beneficiaries": ["y"]}], "empty": []}
    rows = [(k, json.dumps(good | {"ripple_paths": v})) for k, v in cases.items()]
    got = {r["ticker"]: r["problems"] for r in V.validate_analyses(spark.createDataFrame(rows, "ticker string, payload string")).collect()}
    wrong = "ripple_paths 항목이 객체가 아님"
    assert got == {"ok": [], "empty": [], "text": [wrong], "null": [wrong], "ben": ["수혜 후보에 name이 없음"]}
    syn = {k: "x" for k in S.SYNTHESIS_REQUIRED} | {"ideas": [{"axis": S.IDEA_AXES[0], "beneficiaries": ["y"]}]}
    told = V.validate_synthesis(spark.createDataFrame([(1, json.dumps(syn))], "run int, payload string")).first()["problems"]
    assert told == ["priced_in='None' 허용값 아님"]


def test_files_are_read_whole_and_torn_ones_rejected(spark, tmp_path):
    """A later extraction file replaces the whole entry; torn, foreign and blank files never stop a run."""
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("extract_a.json", '{"000010": {"products": [1, 2],\n "upstream": []}, "000020": {"products": [3]}}')
    put("extract_b.json", '{"000010": {"products": []}}')
    put("extract_c.json", '{"000020": {"prod')
    put("extract_d.json", "[1, 2]")
    put("extract_e.json", "  ")
    found, rejects = J.read_extractions(spark, str(tmp_path))
    assert {(r["ticker"], r["payload"].replace(" ", ""), r["file"]) for r in found.collect()} == {
        ("000010", '{"products":[]}', "extract_b.json"), ("000020", '{"products":[3]}', "extract_a.json")}
    assert {r["file"] for r in rejects.collect()} == {"extract_c.json", "extract_d.json"}


def test_torn_edge_and_case_files(spark, tmp_path):
    good = '{"src": "I:a", "dst": "I:b", "rel": "' + S.RELATIONS[1] + '", "sign": 0, "source": "dart", "confidence": 0.5}'
    (tmp_path / "e.jsonl").write_text(f'{good}\n{{"src": "I:a\n\n{good}\n', encoding="utf-8")
    assert J.read_edges(spark, str(tmp_path)).count() == 2
    assert [tuple(r) for r in J.rejected_edges(spark, str(tmp_path)).collect()] == [("e.jsonl", '{"src": "I:a')]
    cases = tmp_path / "cases"
    cases.mkdir()
    for name, text in (("20240101.json", '{"synthesis": {"market_summary": "m",\n "ideas": []}}'), ("20240102.json", '{"synth'),
                       ("20241399.json", "{}"), ("notes.json", "{"), ("20240103.txt", "{}")):
        (cases / name).write_text(text, encoding="utf-8")
    read, rejects = J.load_cases(spark, str(cases))
    assert [str(r["base_date"]) for r in read.collect()] == ["2024-01-01"]
    assert [r["file"] for r in rejects.collect()] == ["20240102.json"]


def test_case_files_are_written_by_day_and_read_back_whole(spark):
    """Every dated case of every day, told under its own day."""
    from pathlib import Path

    from tideline.plans import inputs as I
    from tideline.plans import outcomes as O
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("shared tables not present")
    good = I.table(spark, sf, "orders").where("o_orderdate >= '2000-01-01' and not (o_orderstatus = 'P' and o_orderpriority = '5-LOW')")
    good = good.join(I.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    want = {str(r[0]): r[1] for r in good.groupBy(F.to_date("o_orderdate").alias("d")).count().collect()}
    got = {str(r["base_date"]): r["n"] for r in O.s14(spark, sf).collect()}
    assert got == want and any(not day.endswith("-01") for day in got)


def test_a_field_of_a_value_that_is_no_object_is_missing(spark):
    from tideline.operators.inference import _field
    texts = ['1', '"name"', '[1, {"name": "x"}]', 'null', 'true', '{}', '{"name": null}', '{"name": "x"}', '{"name": 7}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(_field(F.try_parse_json("t"), "name").alias("f")).collect()
    assert [r["f"] for r in rows] == [None] * 7 + ["x", "7"]


def test_case_documents_are_written_and_parsed_where_rows_are_dealt_out(spark):
    """The reader's filters stay behind the shuffle that bounds a task."""
    from tideline.plans import outcomes as O

    plan = J.read_cases(O.case_files(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    before, _, ahead = plan.partition("Exchange hashpartitioning(o_orderkey")
    assert ahead and "AS content" in before and "Json" in before
    assert "AS content" not in ahead and "Json" not in ahead
