import re

import pytest
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import documents as D
from tideline.functions.contracts import parse_contract
from tideline.operators import disclosures as X
from tideline.operators import graph as R
from tideline.operators import names as NM
from tideline.operators import news as W
from tideline.runtime import ROWS_A_TASK, spread

BODY = "가나다 " * 80


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize("text,inside,outside", [
    (f"I. 개요\n연혁\nII. 사업의 내용\n유연탄 {BODY}\nIII. 재무에 관한 사항\n표", "유연탄", "표"),
    (f"목차\nII. 사업의 내용\nIII. 재무제표\nⅡ. 사업의  내용\n유연탄 {BODY}\nⅢ. 재무에 관한 사항\n표", "유연탄", "목차"),
    (f"2. 사업의 내용\n유연탄 {BODY}\n3. 재무제표\n끝\nⅡ. 사업의 내용 - 5. 위험관리를 참조하시기 바랍니다\n{BODY * 4}",
     "유연탄", "위험관리"),
])
def test_section_is_the_bounded_chapter(spark, text, inside, outside):
    got = one(spark, text, D.business_section)
    assert inside in got and outside not in got


def test_section_absent_or_short_is_empty(spark):
    assert one(spark, "I. 개요\n" + BODY * 9, D.business_section) == ""
    assert one(spark, "II. 사업의 내용\n짧음\nIII. 재무제표", D.business_section) == ""
    assert one(spark, "II. 사업의 내용\n" + BODY, D.business_section).startswith("II.")


SECTION = "\n".join(["서두", "1. 사업의 개요", "당사는 레미콘 제조 " + BODY * 3, "2. 위험관리", "환율 " + BODY * 3,
                     "가. 원재료 현황", "유연탄 | 38%" + BODY * 3, "(3) 주요 용어 해설", "사전 " + BODY * 3])


def test_slim_keeps_only_chain_parts(spark):
    got = one(spark, SECTION, D.slim_section)
    assert got["titles"] == ["사업의 개요", "원재료 현황"] and "환율" not in got["text"] and "유연탄" in got["text"]
    few = one(spark, "1. 사업의 개요\n" + BODY, D.slim_section)
    assert few["titles"] == [] and few["text"].startswith("1.")


def digest_by_hand(section, budget=1200):
    def window(t, size):
        if len(t) <= size:
            return t
        step, span = max(1, size // 4), max(1, len(t) - size)
        scored = [(len(re.findall(S.PRODUCT_CUE, t[i:i + size])) + .5 * len(re.findall(S.SELF_REFERENCE, t[i:i + size]))
                   - 3 * i / span, -i) for i in range(0, len(t) - size + step, step)]
        return t[-max(scored)[1]:][:size]
    marks = [m for m in re.finditer(S.SUBSECTION_LINE, section, re.M) if m.group(1).strip()]
    if len(marks) < 2:
        return section[:budget]
    ends = [m.start() for m in marks[1:]] + [len(section)]
    parts = [window(section[m.start():e].strip(), 900) for m, e in zip(marks, ends)
             if re.search(S.DIGEST_KEEP, m.group(1)) and not re.search(S.DIGEST_DROP, m.group(1))]
    return window("\n\n".join(parts).strip() or section, budget)


@pytest.mark.parametrize("text", [SECTION, "제목 없음 " * 400, "1. 매출실적\n" + "x" * 1500 + " 당사 제조 판매 " + "y" * 1500
                                  + "\n2. 기타\nz", "1. 가격\nq\n2. 원료\n" + "생산 " * 900])
def test_digest_equals_window_by_window_restatement(spark, text):
    assert one(spark, text, D.membership_digest) == digest_by_hand(text)


def test_markup_keeps_cells_and_decodes_references(spark):
    xml = "<TABLE><TR><TD>유연탄</TD><TE>71.0%</TE></TR></TABLE><P>제조&#183;판매&nbsp;A&amp;B<!-- 주석 --></P><BR/>끝"
    got = one(spark, xml, D.markup_to_text)
    assert "유연탄 | 71.0%" in got and "제조·판매 A&B" in got and "주석" not in got and got.endswith("끝")


@pytest.mark.parametrize("quote,ok", [("레미콘 | 38.0%", True), ("당사는   레미콘을\n제조한다", True), ("레미콘을", False),
                                      ("지어낸 문장이 여기에 있다", False), ("38.0", False), ("", False)])
def test_quotes_must_be_in_the_source(spark, quote, ok):
    src = "당사는 레미콘을 제조한다.\n레미콘 | 38.0% | 석회석"
    df = spark.createDataFrame([(quote, src)], "q string, s string")
    assert df.select(D.quote_holds(D.squash(F.col("q")), D.squash(F.col("s"))).alias("o")).first()["o"] is ok


@pytest.mark.parametrize("name,text,ok", [
    ("푸른솔", "푸른솔유치원 협약 공시", False), ("푸른솔", "푸른솔은 공시했다", True), ("물결", "물결 사진 동호회 수주", True),
    ("물결", "물결마을 실적", False), ("물결", "신제품 물결", True), ("A.B(주)", "AxB(주) 공시", False), ("A.B(주)", "A.B(주) 공시", True)])
def test_name_boundaries(spark, name, text, ok):
    df = spark.createDataFrame([(name, text)], "n string, t string")
    assert df.select(D.mentions_company(F.col("n"), F.col("t")).alias("o")).first()["o"] is ok


def test_contract_form(spark):
    form = ("수주 내역 안내\n가) 계약상대방: 새벽기계(주)\n나) 판매·공급 지역: 제주\n다) 공급 품목: 풍력 날개 (단위: 기)\n"
            "이행 시작일: 2021/03/04, 이행 종료일: 2024년 5월 6일\n라) 최근 매출액: 2019년 300,000,000,000원\n"
            "마) 계약 금액: 61,500,000,000원\n바) 매출액 대비 (%) 20.5")
    got = one(spark, form, parse_contract).asDict()
    assert got == {"counterparty": "새벽기계(주)", "product": "풍력 날개", "amount": 61_500_000_000.0,
                   "recent_sales": 300_000_000_000.0, "sales_ratio": 0.205, "begin": "20210304", "end": "20240506",
                   "region": "제주"}
    line = one(spark, "계약 상대: 해당사항 없음\n계약 기간: 2020.1.2부터 2023년 4월 5일", parse_contract)
    assert (line["begin"], line["end"], line["counterparty"], line["amount"]) == ("20200102", "20230405", "", None)
    assert one(spark, "매출액대비 20000%", parse_contract)["sales_ratio"] is None


def test_contract_edges_use_own_ratio_only_with_plausible_sales(spark):
    m = spark.createDataFrame([("000001", "파는곳", 1), ("000002", "사는곳", 1)], "ticker string, name string, market_cap long")
    schema = ("rcept_no string, report_nm string, rcept_dt string, corp_name string, stock_code string, parsed struct<"
              "counterparty:string,product:string,amount:double,recent_sales:double,sales_ratio:double,begin:string,"
              "end:string,region:string>")
    deal = lambda no, who, amount, sales, ratio, code="000001": (
        no, "공급계약", "20240101", "corp", code, (who, "p", amount, sales, ratio, "20240101", "20250101", ""))
    rows = [deal("1", "사는곳", 5e9, 1e10, None)]
    e, _ = X.contract_edges(spark.createDataFrame(rows, schema), m, NM.name_index(m), "1")
    r = e.first()
    assert (r["src"], r["dst"], r["weight"]) == ("T:000001", "T:000002", 0.5)
    assert r["evidence"] == "공급계약(20240101) 20240101~20250101 5,000,000,000원"
    rows = [deal("2", "사는곳", 5e9, 2019.0, None), deal("3", "외국회사", 1.0, 1e9, None), deal("4", "파는곳", 1.0, 1e9, None),
            deal("5", "사는곳", 1.0, 1e9, None, "999999")]
    e, unlisted = X.contract_edges(spark.createDataFrame(rows, schema), m, NM.name_index(m), "1")
    assert [r["weight"] for r in e.collect()] == [None] and [r["company"] for r in unlisted.collect()] == ["외국회사"]


def test_blanks_are_stripped_as_the_pattern_says(spark):
    for c in map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xa0, 0x1680, 0x2003, 0x200a, 0x2028, 0x202f, 0x205f, 0x3000, 0x200b, 0x180e)):
        text = f"{c}{c}a{c}b{c}"
        assert one(spark, text, D.strip_ws) == one(spark, text, lambda t: F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")), hex(ord(c))


def test_only_the_newest_contract_of_a_pair_is_read_whole(spark):
    m = spark.createDataFrame([("000001", "파는곳", 1), ("000002", "사는곳", 1)], "ticker string, name string, market_cap long")
    form = "계약상대방: {}\n계약 금액: {}원\n최근 매출액: 10,000,000,000원\n비고 시작일"
    rows = [(str(i), "공급계약", day, "corp", "000001", form.format(who, amount)) for i, (day, who, amount) in enumerate([
        ("20240101", "사는곳", "1,000,000,000"), ("20240103", "사는곳", "2,000,000,000"), ("20240103", " 사는곳 ※", "3,000,000,000"),
        ("20240102", "외국회사", "1,000"), ("20240105", "파는곳", "1,000"), ("20240105", "해당사항 없음", "1,000")])]
    f = spark.createDataFrame(rows, "rcept_no string, report_nm string, rcept_dt string, corp_name string, stock_code string, text string").cache()
    ix = NM.name_index(m)
    parties, parsed = X.contract_parties(f).cache(), X.parsed_contracts(f).cache()
    assert sorted(parties.select("rcept_no", "company").collect()) == sorted(parsed.select("rcept_no", "parsed.counterparty").collect())
    newest = X.newest_contracts(parties, m, ix)
    assert [r["rcept_no"] for r in newest.collect()] == ["2"]
    whole, few = (R.merge(X.contract_edges(p, m, ix, "1")[0]).collect() for p in (parsed, parsed.join(newest, "rcept_no", "left_semi")))
    assert whole == few and whole[0]["weight"] == 0.3
    assert X.unlisted_buyers(parties, m, ix).collect() == X.contract_edges(parsed, m, ix, "1")[1].collect()


def test_costly_rows_are_dealt_into_tasks_of_bounded_size(spark):
    assert spread(spark.range(10), "id", rows=5 * ROWS_A_TASK + 1).rdd.getNumPartitions() == 6
    assert spread(spark.range(10), "id").rdd.getNumPartitions() == 4


ITEM = "ticker string, side string, pos int, industry string, share double, tier string, what string, segment string, quote string"


def test_filing_edges_anchor_on_segment_or_guess(spark):
    items = spark.createDataFrame([
        ("1", "products", 0, "조선", 0.7, "B", "선박", "", "q1"), ("1", "products", 1, "조선", 0.1, "A", "블록", "", "q2"),
        ("1", "products", 2, "태양광", None, "C", "모듈", "", "q3"),
        ("1", "upstream", 0, "웨이퍼", 0.2, "B", "웨이퍼", "태양광", "q4"), ("1", "upstream", 1, "철강", None, "B", "후판", "", "q5"),
        ("2", "upstream", 0, "철강", None, "B", "강판", "", "q6")], ITEM)
    f = X.fold(items)
    segs = spark.createDataFrame([("태양광", "태양광")], "name string, industry string")
    rows = {(r["src"], r["dst"]): r for r in X.filing_edges(f, segs, "1").collect()}
    ship = rows[("T:1", "I:조선")]
    assert (ship["weight"], ship["confidence"], ship["product"], ship["evidence"]) == (0.8, 0.85, "선박 / 블록", "q2")
    assert rows[("I:태양광", "I:웨이퍼")]["attribution"] == S.ATTRIBUTION_CONFIRMED
    assert rows[("I:조선", "I:철강")]["attribution"] == S.ATTRIBUTION_GUESSED
    assert rows[("I:태양광", "I:웨이퍼")]["weight"] == 0.2 and rows[("I:웨이퍼", "I:태양광")]["weight"] is None
    assert rows[("I:웨이퍼", "I:태양광")]["rel"] == S.REL_DOWNSTREAM
    assert [r["ticker"] for r in X.relations_without_products(f).collect()] == ["2"]


def test_counterparties_come_from_the_customer_text_only(spark):
    m = spark.createDataFrame([("005490", "POSCO홀딩스", 1), ("005380", "현대자동차", 1), ("000270", "기아", 1),
                               ("011200", "한화엔진", 1)], "ticker string, name string, market_cap long")
    items = spark.createDataFrame([
        ("000001", "downstream", 0, "x", None, "A", "현대차(21.4%), 기아 전방산업, Ultium Cells", "", "한화엔진에 판다"),
        ("000001", "upstream", 1, "x", None, "A", "포스코 강재", "", "q")], ITEM)
    alias = spark.createDataFrame(list(S.COUNTERPARTY_ALIASES.items()), "alias string, target string")
    e, unlisted = X.company_trades(items, m, NM.name_index(m), alias, "1")
    got = {(r["src"], r["dst"]): r["weight"] for r in e.collect()}
    assert got == {("T:000001", "T:005380"): 0.214, ("T:005490", "T:000001"): None}
    assert {r["token"] for r in unlisted.collect()} == {"Ultium", "Cells"}


def test_a_counterparty_text_of_many_items_is_taken_apart_once(spark):
    m = spark.createDataFrame([("000001", "가나전자", 1), ("000002", "다라전자", 1)], "ticker string, name string, market_cap long")
    text = "가나전자 12.5%, 다라전자(7%), Ultium"
    items = spark.createDataFrame([(t, "downstream", i, "x", None, "A", text, "", f"q{t}{i}")
                                   for t in ("000001", "000002", "000003") for i in (0, 1)], ITEM)
    alias = spark.createDataFrame(list(S.COUNTERPARTY_ALIASES.items()), "alias string, target string")
    e, unlisted = X.company_trades(items, m, NM.name_index(m), alias, "1")
    assert sorted((r["src"], r["dst"], r["weight"], r["evidence"]) for r in R.merge(e).collect()) == [
        ("T:000001", "T:000002", 0.07, "q0000011"), ("T:000002", "T:000001", 0.125, "q0000021"),
        ("T:000003", "T:000001", 0.125, "q0000031"), ("T:000003", "T:000002", 0.07, "q0000031")]
    assert sorted(r["ticker"] for r in unlisted.where("token = 'Ultium'").collect()) == ["000001", "000002", "000003"]
    for df in (e, unlisted):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")
        assert len(plan) > 1 and all("Aggregate [text" in p.split("Relation")[0].split("RDD")[0] for p in plan[1:])


def test_news_quota_counts_only_what_was_looked_at(spark):
    item = lambda i, title: ("물결", title, "", f"{i:03d}", f"2024-01-{20 - i:02d} 00:00:00")
    rows = [item(1, "물결 수주"), item(2, "물결마을 수주"), item(3, "물결 계약"), item(4, "물결 실적"), item(19, "물결 공시"),
            ("없음", "없음공사", "", "1", "2024-01-19 00:00:00")]
    df = spark.createDataFrame(rows, "name string, title string, description string, link string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    s = W.scored_news(df, "2024-01-21")
    assert [r["link"] for r in W.news_quota(s, 2).orderBy("rank").collect()] == ["001", "003"]
    st = {r["name"]: (r["raw"], r["kept"], r["all_noise"]) for r in W.news_stats(s, 2).collect()}
    assert st == {"물결": (3, 2, False), "없음": (1, 0, True)}


def test_report_choice_falls_through_to_the_next_candidate(spark):
    good = f"II. 사업의 내용\n{BODY}\nIII. 재무제표"
    rows = [("c", "1", "사업보고서 (2023.12)", "20240301", "본문 없음"), ("c", "2", "사업보고서 (2022.12)", "20230301", good),
            ("c", "3", "분기보고서 (2024.03)", "20240501", good), ("d", "4", "주요사항보고서", "20240501", good)]
    df = spark.createDataFrame(rows, "corp_code string, rcept_no string, report_nm string, rcept_dt string, text string")
    assert [(r["corp_code"], r["rcept_no"], r["rank"]) for r in X.report_sections(df).collect()] == [("c", "2", 2)]


def test_number_alone_takes_the_next_line_as_title(spark):
    text = "1. 회사 개요\n본문 하나\n2.\n가. 주요 제품\n본문 둘\n나. 원재료\n본문 셋"
    subs = spark.createDataFrame([(text,)], "t string").select(D.subsections(F.col("t")).alias("s")).first()["s"]
    assert [s["title"] for s in subs] == ["회사 개요", "가. 주요 제품", "원재료"]
    assert subs[1]["body"].startswith("2.\n가. 주요 제품") and "".join(s["body"] for s in subs) == text


ODD_PAGES = ("a&ampb &amp; &notit; &copy2024 &hellip; &#183;&#xB7;&#x80;&#0;&#1114112;&#00065 &#xD800; &#1; &nosuch; & &;",
             "<td>a&nbsp;</td><td>&#160;　b</td>", "x<!-- & -->y<br/> &lt;p&gt;</P \x0b>z", "&AMP;amp; &am &ampamp;", "", None)


def test_markup_sql_decodes_every_reference(spark):
    import duckdb

    from oracles import all_sql
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(ODD_PAGES)))
    df = spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string")
    ours = {r[0]: r[1] for r in df.select("page_id", D.markup_to_text(F.col("html"))).collect()}
    assert ours[0].startswith("a&b & ¬it; ©2024 … ··€��A �")
    assert ours == dict(con.execute(all_sql()["c10_markup_to_text"]).fetchall())


ODD_TEXTS = (("산업 " * 300 + "\n(7)\n사업의 개요\n매출 " + "가 " * 500, "fr", "a"),
             (" 글 " * 300 + "\n٣. 수주　현황 \n" + "나 " * 400 + "　", "de", "b "), (None, "de", "c"), ("다 " * 500, None, None),
             ("라\n12.\n13. 매출\n" * 90, "es", ""), ("x " * 600, "en", "e"))


def test_slim_section_sql_reads_headings_as_the_query_does(spark, tmp_path):
    import duckdb

    from oracles import all_sql
    from tideline.plans import all_queries
    rows = [(i, t, lang, s, len(t or "")) for i, (t, lang, s) in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = all_queries()["c12_slim_section"](spark, str(tmp_path)).select("doc_id", "text", "titles")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(all_sql()["c12_slim_section"]).fetchall())
