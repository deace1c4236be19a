"""Checks for tideline.plans.outcomes: expectations follow from the columns the JSON was written from."""

from oracles.base import CENTS, SUPP, cte, r

_NAME = "'Supplier#' || lpad(({0} // {1})::VARCHAR, 9, '0')"
cte("cust", f"""
    SELECT c_custkey::VARCHAR AS ticker, c_custkey, c_mktsegment AS seg, c_acctbal AS bal, n_name, c_nationkey < 2 AS broken,
           CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 9000 THEN '' ELSE {_NAME.format('c_custkey', 10)} END AS n1,
           CASE WHEN c_acctbal > 8000 THEN '중립' WHEN c_acctbal > 4000 THEN '피해' ELSE '수혜' END AS i1,
           {_NAME.format('c_custkey', 15)} AS n2
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
cte("cust_problems", """
    SELECT ticker, '객체가 아님' AS problem FROM cust WHERE broken
    UNION ALL SELECT ticker, '필수 항목 ''evidence'' 누락' FROM cust WHERE NOT broken AND seg = 'MACHINERY'
    UNION ALL SELECT ticker, 'cause_type=''X''는 허용값이 아님' FROM cust WHERE NOT broken AND bal < 0
    UNION ALL SELECT ticker, 'direction=''옆산업'' 허용값 아님' FROM cust WHERE NOT broken AND seg = 'FURNITURE'
    UNION ALL SELECT ticker, CASE WHEN n1 = '' THEN '수혜 후보에 name이 없음' ELSE 'impact=''중립'' 허용값 아님' END
        FROM cust WHERE NOT broken AND seg <> 'AUTOMOBILE' AND (n1 = '' OR i1 = '중립')
    UNION ALL SELECT ticker, '회사고유인데 파급 경로가 있음' FROM cust WHERE NOT broken AND seg = 'BUILDING'""")
cte("cust_ok", "SELECT * FROM cust WHERE ticker NOT IN (SELECT ticker FROM cust_problems)")
cte("syn", f"""
    SELECT o_orderkey AS run, CAST(o_orderdate AS DATE) AS base_date, o_orderstatus AS st, o_orderpriority AS prio,
           {_NAME.format('o_custkey', 10)} AS name, m.ticker,
           CASE o_orderstatus WHEN 'F' THEN '피해' ELSE '수혜' END AS impact,
           CASE o_orderstatus WHEN 'F' THEN '피해' WHEN 'O' THEN '수혜' END AS raw_impact,
           CASE o_orderpriority WHEN '1-URGENT' THEN '모름' WHEN '3-MEDIUM' THEN '미반영' WHEN '5-LOW' THEN '기반영'
                ELSE '일부반영' END AS priced_in, (o_custkey % 50) / 1000.0::DOUBLE AS gap,
           o_totalprice > 250000 AS graph_backed, CASE WHEN o_totalprice > 250000 THEN n_name || '→동종' END AS via,
           CASE WHEN o_orderstatus = 'P' THEN '대각' WHEN o_orderpriority = '5-LOW' THEN '수평' ELSE '수직' END AS axis
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN sm_master m ON m.name = {_NAME.format('o_custkey', 10)}""")
cte("syn_problems", """
    SELECT run, '''market_summary'' 누락' AS problem FROM syn WHERE prio = '2-HIGH'
    UNION ALL SELECT run, 'axis=''대각'' 허용값 아님' FROM syn WHERE st = 'P'
    UNION ALL SELECT run, 'priced_in=''모름'' 허용값 아님' FROM syn WHERE prio = '1-URGENT'""")
cte("bens", """
    SELECT 'analysis' AS shape, ticker AS origin, n1 AS name, i1 AS impact FROM cust_ok WHERE seg <> 'AUTOMOBILE'
    UNION ALL SELECT 'analysis', ticker, n2, '수혜' FROM cust_ok WHERE seg <> 'AUTOMOBILE'
    UNION ALL SELECT 'synthesis', run::VARCHAR, name, raw_impact FROM syn
        WHERE run NOT IN (SELECT run FROM syn_problems)""")
cte("bens_ann", """
    SELECT b.*, m.ticker, ret5, ret20, gap, grp AS gap_group FROM bens b LEFT JOIN sm_master m USING (name)
    LEFT JOIN sm_sig s ON s.ticker = m.ticker
    LEFT JOIN (SELECT * FROM gaps QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY gap DESC, grp) = 1) g
      ON g.ticker = m.ticker""")
cte("reach_all", """
    SELECT other AS ticker, via FROM reach JOIN (SELECT ticker, pos FROM sm_screen WHERE pos <= 20) USING (ticker)
    QUALIFY row_number() OVER (PARTITION BY other ORDER BY pos, prio, via) = 1""")
cte("bens_marked", """
    SELECT b.*, r.via, r.via IS NOT NULL AS graph_backed FROM bens_ann b LEFT JOIN reach_all r USING (ticker)
    WHERE b.ticker IS NOT NULL""")
cte("good_cases", "SELECT * FROM syn WHERE base_date >= DATE '2000-01-01' AND NOT (st = 'P' AND prio = '5-LOW')")
cte("preds", """
    SELECT base_date, prio AS idea, axis, name, ticker, impact, priced_in, gap, graph_backed, via FROM good_cases
    WHERE ticker IS NOT NULL AND base_date <= DATE '2001-07-01' - 15""")
cte("sup_days", f"""
    SELECT {SUPP} AS ticker, CAST(l_shipdate AS DATE) AS d, sum({CENTS}) / (sum(l_quantity) * 100.0) AS close
    FROM lineitem GROUP BY 1, 2""")
cte("fwd", """
    SELECT ticker, base_date, max(close) FILTER (rn = 6) / max(close) FILTER (rn = 1) - 1 AS forward_return FROM (
        SELECT p.ticker, p.base_date, close, row_number() OVER (PARTITION BY p.ticker, p.base_date ORDER BY d) AS rn
        FROM (SELECT DISTINCT ticker, base_date FROM preds) p JOIN sup_days s
          ON s.ticker = p.ticker AND d BETWEEN p.base_date AND p.base_date + 22)
    GROUP BY 1, 2 HAVING max(rn) > 5""")
cte("results", "SELECT * FROM preds JOIN fwd USING (ticker, base_date)")
cte("result_dims", """
    SELECT 'overall' AS dim, '' AS value, forward_return FROM results
    UNION ALL SELECT 'priced_in', priced_in, forward_return FROM results WHERE priced_in <> '모름'
    UNION ALL SELECT 'axis', axis, forward_return FROM results WHERE axis <> '대각'
    UNION ALL SELECT 'impact', impact, forward_return FROM results
    UNION ALL SELECT 'provenance', CASE WHEN graph_backed THEN '그래프기반' ELSE 'LLM창작' END, forward_return FROM results
    UNION ALL SELECT 'path', via, forward_return FROM results WHERE via IS NOT NULL""")

SQL = {
    "c23_validate_analyses": "SELECT ticker, problem FROM cust_problems",
    "c23_validate_synthesis": "SELECT run, problem FROM syn_problems",
    "f10_scope_filter": """
        SELECT ticker, n_name AS industry FROM cust_ok WHERE seg NOT IN ('BUILDING', 'AUTOMOBILE')""",
    "c22_beneficiaries": "SELECT shape, origin, name, impact FROM bens",
    "j10_annotate_priced_in": f"""
        SELECT shape, origin, name, ticker, {r('ret5', 6)} AS ret5, {r('ret20', 6)} AS ret20, {r('gap', 6)} AS gap,
               gap_group FROM bens_ann""",
    "j10_match_stats": "SELECT shape, count(ticker) AS matched, count(*) AS total FROM bens_ann GROUP BY 1",
    "j10_unmatched_names": "SELECT DISTINCT shape, name FROM bens_ann WHERE ticker IS NULL",
    "j11_provenance": "SELECT shape, origin, ticker, graph_backed, via FROM bens_marked",
    "j11_provenance_stats": """
        SELECT shape, count(*) FILTER (graph_backed) AS graph_backed, count(*) AS total FROM bens_marked GROUP BY 1""",
    "j17_attach_membership": """
        SELECT ticker, groups, industries FROM sm_master
        LEFT JOIN (SELECT ticker, string_agg(grp, '|' ORDER BY grp) AS groups FROM grp_members GROUP BY 1) USING (ticker)
        LEFT JOIN (SELECT ticker, string_agg(industry, '|' ORDER BY industry) AS industries FROM mem GROUP BY 1)
        USING (ticker)""",
    "s13_edges_jsonl": f"""
        SELECT source, rel, count(*) AS n, {r('sum(confidence)', 4)} AS confidence FROM every_edge GROUP BY 1, 2""",
    "s14_case_source": """
        SELECT CAST(base_date AS VARCHAR) AS base_date, count(*) AS n, count(*) FILTER (prio <> '2-HIGH') AS told
        FROM good_cases GROUP BY 1""",
    "s13_edge_rejects": "SELECT 'torn.jsonl' AS file, count(*) AS n FROM events WHERE event_type = 'error' HAVING count(*) > 0",
    "s14_case_rejects": """
        SELECT strftime(o_orderdate, '%Y%m') || '01.json' AS file, count(*) AS n FROM orders
        WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND strftime(o_orderdate, '%Y') LIKE '2%' GROUP BY 1""",
    "f7_age_filter": """
        SELECT CAST(base_date AS VARCHAR) AS base_date, idea, axis, name, ticker, impact, priced_in,
               round(gap, 6) AS gap, graph_backed, via FROM preds""",
    "w8_forward_return": f"""
        SELECT ticker, CAST(base_date AS VARCHAR) AS base_date, {r('forward_return', 8)} AS forward_return FROM fwd""",
    "j16_forward_price": f"""
        SELECT CAST(base_date AS VARCHAR) AS base_date, idea, name, ticker, {r('forward_return', 8)} AS forward_return
        FROM results""",
    "a13_score_summary": f"""
        SELECT dim, value, count(*) AS n, {r('avg(forward_return)', 7)} AS mean,
               {r('median(forward_return)', 7)} AS median,
               {r('avg(CAST(forward_return > 0 AS INT))', 7)} AS hit_rate
        FROM result_dims GROUP BY 1, 2 HAVING dim <> 'path' OR count(*) >= 3""",
    "a14_directional_hit": f"""
        SELECT count(*) AS n, {r("avg(CAST(CASE WHEN impact = '수혜' THEN forward_return > 0 ELSE forward_return < 0 END AS INT))", 7)}
               AS directional_hit_rate FROM results""",
    "a15_gap_validity": f"""
        SELECT n, {r('c', 7)} AS corr, top_n, {r('m', 7)} AS top_mean, {r('h', 7)} AS top_hit_rate
        FROM (SELECT count(*) AS n, corr(gap, forward_return) AS c FROM results HAVING count(*) >= 5),
             (SELECT count(*) AS top_n, avg(forward_return) AS m, avg(CAST(forward_return > 0 AS INT)) AS h
              FROM (SELECT forward_return, row_number() OVER (ORDER BY gap DESC, base_date, ticker, idea, name) AS rn,
                           count(*) OVER () AS k FROM results) WHERE rn <= greatest(1, k // 4))""",
}
