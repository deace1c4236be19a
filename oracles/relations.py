"""Checks for tideline.plans.relations."""

from oracles.base import CENTS, PAD6, SUPP, S_TICKER, cte, r

P_TICKER = PAD6.format("p_partkey::VARCHAR")

cte("strong_flows", """
    SELECT customer_nation, supplier_nation FROM nation_flows
    JOIN (SELECT customer_nation, sum(cents) AS total, count(*) AS n FROM nation_flows GROUP BY 1) t
    USING (customer_nation)
    WHERE cents * n * 10 >= total * 13 AND customer_nation <> supplier_nation""")
cte("lead_supplier", """
    SELECT sector, name FROM sm_master WHERE market_cap IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC, ticker) = 1""")
cte("map_rows", f"""
    SELECT lower(n_name) || '.yaml' AS map_file, n_name AS industry, 'peers' AS block,
           n_name AS target, company, 0 AS bo
    FROM (SELECT s_nationkey AS nk, CASE WHEN s_acctbal < 1000 THEN 'x(' || {S_TICKER} || ')'
                 ELSE s_name END AS company FROM supplier
          UNION ALL SELECT c_nationkey, c_name FROM customer WHERE c_acctbal < -900)
    JOIN nation ON nk = n_nationkey
    UNION ALL
    SELECT lower(customer_nation) || '.yaml', customer_nation, 'upstream', supplier_nation, name, 1
    FROM strong_flows LEFT JOIN lead_supplier ON sector = supplier_nation""")
cte("map_resolved", """
    SELECT company, CASE WHEN company LIKE 'x(%' THEN e.ticker ELSE b.ticker END AS ticker
    FROM (SELECT DISTINCT company FROM map_rows WHERE company IS NOT NULL)
    LEFT JOIN sm_master e ON company = 'x(' || e.ticker || ')'
    LEFT JOIN sm_master b ON company = b.name""")
cte("map_members", """
    SELECT 'T:' || ticker AS src, 'I:' || target AS dst,
           arg_max(map_file || ': ' || company, map_file || '|' || bo || '|' || target || '|' || company)
               AS evidence
    FROM map_rows JOIN map_resolved USING (company) WHERE ticker IS NOT NULL GROUP BY 1, 2""")
cte("map_flow", """
    SELECT 'I:' || customer_nation AS src, 'I:' || supplier_nation AS dst, '후방' AS rel,
           lower(customer_nation) || '.yaml' AS evidence FROM strong_flows
    UNION ALL SELECT 'I:' || supplier_nation, 'I:' || customer_nation, '전방',
           lower(customer_nation) || '.yaml' FROM strong_flows""")
_BLANK = """CAST(0 AS BIGINT) AS sign, CAST(NULL AS DOUBLE) AS weight, 'valuechain' AS source,
    '' AS origin, 0.5::DOUBLE AS confidence, evidence, '20011101' AS asof, '' AS product,
    '' AS attribution"""
cte("map_edge_rows", f"""
    SELECT src, dst, '소속' AS rel, {_BLANK} FROM map_members
    UNION ALL SELECT src, dst, rel, {_BLANK} FROM map_flow""")
cte("best_goods", f"""
    SELECT {SUPP} AS ticker, p_name AS product FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY {SUPP} ORDER BY sum({CENTS}) DESC, p_name) = 1""")
cte("disclosed_rows", """
    SELECT 'T:' || ticker AS src, 'I:' || sector AS dst, '소속' AS rel, CAST(0 AS BIGINT) AS sign,
           CAST(NULL AS DOUBLE) AS weight, 'dart' AS source, ticker AS origin,
           0.85::DOUBLE AS confidence, name AS evidence, '20011101' AS asof, product,
           '' AS attribution
    FROM best_goods JOIN sm_master USING (ticker)""")
cte("horizontal_rows", f"""
    SELECT 'T:' || m.ticker AS src, 'D:' || m.grp AS dst, '노출' AS rel, CAST(1 AS BIGINT) AS sign,
           {r('g.beta', 2)} AS weight, 'theme_index' AS source, '' AS origin,
           0.7::DOUBLE AS confidence, m.grp AS evidence, '20011101' AS asof, '' AS product,
           '' AS attribution
    FROM grp_members m LEFT JOIN gaps g ON g.grp = m.grp AND g.ticker = m.ticker
    WHERE m.grp NOT LIKE '산업:%'
    UNION ALL
    SELECT 'T:' || ticker, 'D:' || factor, '노출', CASE WHEN {r('beta', 3)} >= 0 THEN 1 ELSE -1 END,
           {r('beta', 3)}, 'factor_beta', '', least(0.9, abs({r('corr', 3)})), '', '20011101', '', ''
    FROM expo""")
cte("every_edge", """
    SELECT * FROM map_edge_rows UNION ALL SELECT * FROM disclosed_rows
    UNION ALL SELECT * FROM horizontal_rows""")
cte("mem_edges", """
    SELECT substr(src, 3) AS ticker, substr(dst, 3) AS industry, confidence, source, origin
    FROM every_edge WHERE rel = '소속'""")
cte("mem", "SELECT DISTINCT industry, ticker FROM mem_edges")
cte("vert", f"""
    SELECT ticker, from_industry, industry, relation, max(conf) AS confidence,
           arg_min(s2, (-conf, s1, o1, s2, o2)) AS source,
           string_agg(DISTINCT s2, '+' ORDER BY s2) AS sources
    FROM (SELECT m.ticker, m.industry AS from_industry, substr(v.dst, 3) AS industry,
                 v.rel AS relation, round(m.confidence * v.confidence, 3) AS conf, m.source AS s1,
                 m.origin AS o1, v.source AS s2, v.origin AS o2
          FROM mem_edges m
          JOIN every_edge v ON v.src = 'I:' || m.industry AND v.rel IN ('후방', '전방'))
    GROUP BY 1, 2, 3, 4""")
cte("peer_rows", """
    SELECT a.ticker, a.industry, b.ticker AS other FROM mem a JOIN mem b ON a.industry = b.industry AND a.ticker <> b.ticker""")
cte("exposed", """
    SELECT substr(src, 3) AS ticker, substr(dst, 3) AS driver, sign, weight, source
    FROM every_edge WHERE rel = '노출'""")
cte("co_rows", """
    SELECT a.ticker, a.driver, a.sign AS my_sign, a.weight AS my_weight, a.source, b.ticker AS other,
           b.sign, b.weight, b.source AS other_source
    FROM exposed a JOIN exposed b ON a.driver = b.driver AND a.ticker <> b.ticker""")
cte("reach", """
    SELECT ticker, other, via, prio FROM (
        SELECT v.ticker, m.ticker AS other, from_industry || '→' || relation || '→' || v.industry AS via,
               CASE relation WHEN '후방' THEN 0 ELSE 1 END AS prio, -confidence AS k
        FROM vert v JOIN mem m ON m.industry = v.industry
        UNION ALL SELECT ticker, other, industry || '→동종', 2, 0 FROM peer_rows
        UNION ALL SELECT ticker, other, '동인:' || driver, 3, 0 FROM co_rows)
    WHERE other <> ticker
    QUALIFY row_number() OVER (PARTITION BY ticker, other ORDER BY prio, k, via) = 1""")
cte("classes", """
    SELECT ticker, min(ticker) OVER (PARTITION BY marks) AS class_id FROM (
        SELECT ticker, string_agg(DISTINCT mark, ';' ORDER BY mark) AS marks FROM (
            SELECT ticker, industry || '|' || confidence::VARCHAR || '|' || source AS mark FROM mem_edges
            UNION ALL SELECT ticker, driver FROM exposed) GROUP BY ticker)""")
cte("lead", "SELECT ticker FROM classes WHERE ticker = class_id")
cte("mem_size", "SELECT industry, count(*) AS n_members FROM mem GROUP BY 1")
cte("driver_n", """
    SELECT driver, count(DISTINCT ticker) FILTER (sign >= 0) AS n_same, count(DISTINCT ticker) FILTER (sign < 0) AS n_opposite
    FROM exposed GROUP BY 1 HAVING count(DISTINCT ticker) > 1""")
cte("shares", """
    SELECT ticker, driver, source, my_sign, my_weight, count(*) FILTER (sign >= 0) AS n_same,
           count(*) FILTER (sign < 0) AS n_opposite FROM co_rows GROUP BY ALL""")
cte("profile_rows", f"""
    SELECT c.ticker, CASE WHEN party % 2 = 0 THEN 1 ELSE 2 END AS rn, other_name, 'goods of ' || party AS products,
           m.ticker AS other
    FROM (SELECT DISTINCT {SUPP} AS ticker, o_custkey // 10 AS party,
                 'Supplier#' || lpad((o_custkey // 10)::VARCHAR, 9, '0') AS other_name
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey) c LEFT JOIN sm_master m ON m.name = other_name""")
cte("spoken", """
    SELECT p_partkey AS pos, CASE WHEN p_size < 10 THEN p_type || ' 산업'
        WHEN p_size < 20 THEN p_name || ' 제조업 부문'
        WHEN p_size < 30 THEN split_part(p_name, ' ', 2) || '사업부문'
        WHEN p_size < 40 THEN lower(p_type) || '·업계' ELSE split_part(p_name, ' ', 2) END AS name
    FROM part""")
cte("spoken_norm", """
    SELECT DISTINCT name, upper(regexp_replace(regexp_replace(name, '[ ·]', '', 'g'),
           '(제조업부문|사업부문|산업|업계)$', '')) AS norm FROM spoken""")
cte("c4_target", """
    SELECT name, pos, CASE WHEN name LIKE 'g%' AND name IN (SELECT split_part(p_name, ' ', 2) FROM part)
                           THEN 'STANDARD' ELSE name END AS t
    FROM (SELECT name, min(pos) AS pos FROM spoken GROUP BY 1)""")
cte("c4_known", "SELECT DISTINCT p_type AS k FROM part")
cte("c4_res", """
    SELECT c.name, CASE WHEN k1.k IS NOT NULL THEN c.t WHEN k2.k IS NOT NULL THEN k2.k
                ELSE first_value(c.t) OVER (PARTITION BY coalesce(s.norm, upper(c.t)) ORDER BY
                     k1.k IS NOT NULL, k2.k IS NOT NULL, c.pos) END AS industry,
           k1.k IS NULL AND k2.k IS NULL AS is_new
    FROM c4_target c LEFT JOIN spoken_norm s ON s.name = c.t
    LEFT JOIN c4_known k1 ON k1.k = c.t LEFT JOIN c4_known k2 ON upper(k2.k) = s.norm""")
cte("part_norm", f"""
    SELECT {P_TICKER} AS ticker, upper(replace(p_name, ' ', '')) AS norm_name,
           CAST(round(p_retailprice * 100) AS BIGINT) AS cap FROM part""")
cte("part_index", """
    SELECT norm_name, ticker, count(*) OVER (PARTITION BY norm_name) AS n FROM part_norm
    QUALIFY row_number() OVER (PARTITION BY norm_name ORDER BY cap DESC, ticker) = 1""")
cte("runs_q", """
    SELECT company, norm, least(length(norm), 4) - 1 AS need,
           unnest(range(1, length(norm) + 1)) AS i
    FROM (SELECT DISTINCT p_name || ' ' || p_type AS company,
                 upper(replace(p_name, ' ', '') || p_type) AS norm FROM part)""")
cte("all_runs", "SELECT company, norm, need, substr(norm, i, k) AS run FROM (SELECT *, unnest(range(1, length(norm) - i + 2)) AS k FROM runs_q)")
cte("near", """
    SELECT company, norm, norm_name, ticker, max(length(run)) AS overlap,
           contains(norm_name, norm) OR contains(norm, norm_name) AS contained
    FROM all_runs JOIN part_index ON contains(norm_name, run)
    WHERE norm <> norm_name GROUP BY ALL HAVING max(length(run)) >= max(need)""")
cte("pref_parents", """
    SELECT m.name AS common_name, p.* FROM (
        SELECT substr(src, 3) AS t, * FROM (SELECT * FROM map_edge_rows UNION ALL
               SELECT * FROM disclosed_rows) WHERE rel = '소속' AND substr(src, 7, 1) <> '7') p
    LEFT JOIN sm_master m ON m.ticker = t""")
cte("prefs", """
    SELECT substr(ticker, 1, 5) || CASE WHEN right(ticker, 1) = '0' THEN 'K' ELSE 'L' END AS pref,
           name || '2우B' AS pref_name, substr(ticker, 1, 5) || '0' AS common FROM sm_master
    WHERE right(ticker, 1) IN ('0', '9') AND length(ticker) = 6""")

SQL = {
    "c1_normalize_name": "SELECT ticker, norm_name FROM part_norm",
    "a29_name_index": "SELECT norm_name, ticker, n FROM part_index",
    "a29_name_collisions": """
        SELECT norm_name, p.ticker, i.ticker AS winner FROM part_norm p
        JOIN part_index i USING (norm_name) WHERE n > 1""",
    "j4_name_resolution": "SELECT company, ticker FROM map_resolved",
    "j4_unresolved_names": "SELECT company FROM map_resolved WHERE ticker IS NULL",
    "c2_near_misses": """
        SELECT company, row_number() OVER w AS rank, norm_name, ticker, overlap, contained FROM near
        WINDOW w AS (PARTITION BY company ORDER BY contained DESC, overlap DESC,
                     abs(length(norm_name) - length(norm)), norm_name)
        QUALIFY row_number() OVER w <= 3""",
    "s11_map_source": "SELECT map_file, industry, block, target, company FROM map_rows",
    "g1_map_edges": "SELECT * FROM map_edge_rows",
    "g2_exposure_edges": "SELECT * EXCLUDE (evidence) FROM horizontal_rows",
    "g3_profile_trades": """
        SELECT 'T:' || CASE WHEN rn = 1 THEN ticker ELSE other END AS src,
               'T:' || CASE WHEN rn = 1 THEN other ELSE ticker END AS dst, '전방' AS rel,
               CAST(0 AS BIGINT) AS sign, CAST(NULL AS DOUBLE) AS weight, 'profile' AS source,
               ticker AS origin, 0.6::DOUBLE AS confidence, 'handbook' AS evidence,
               '20011101' AS asof, products AS product, '' AS attribution
        FROM profile_rows WHERE other IS NOT NULL AND other <> ticker
        QUALIFY row_number() OVER (PARTITION BY src, dst, origin ORDER BY rn DESC, other_name DESC) = 1""",
    "g3_profile_unresolved": """
        SELECT DISTINCT ticker, other_name FROM profile_rows WHERE other IS NULL""",
    "u1_edge_union": """
        SELECT src, dst, rel, sign, weight, source, origin, confidence, product FROM every_edge""",
    "w11_edge_latest": f"""
        SELECT 'T:' || o_custkey AS src, 'D:' || o_orderpriority AS dst,
               {r('o_totalprice / 7919', 4)} AS weight, strftime(o_orderdate, '%Y%m%d') AS asof
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority
            ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "u3_source_partition": """
        SELECT source, rel, count(*) AS n FROM every_edge
        WHERE source IN ('valuechain', 'dart', 'llm', 'profile', 'contract', 'preferred')
        GROUP BY 1, 2""",
    "f4_edge_filter": """
        SELECT src, dst, source, confidence FROM every_edge WHERE rel = '노출' AND confidence >= 0.2""",
    "f6_industry_scope_filter": """
        SELECT '산업:' || industry AS grp, ticker FROM mem
        QUALIFY count(*) OVER (PARTITION BY industry) >= 3""",
    "j5_vertical_2hop": """
        SELECT 'path' AS part, ticker AS class_id, NULL::VARCHAR AS ticker, from_industry, industry, confidence, source,
               sources, relation FROM vert JOIN lead USING (ticker)
        UNION ALL SELECT 'member', class_id, ticker, NULL, NULL, NULL, NULL, NULL, NULL FROM classes""",
    "j6_peers": """
        SELECT 'industry' AS part, ticker AS class_id, NULL::VARCHAR AS ticker, industry,
               1 + (SELECT count(*) FROM peer_rows p WHERE p.ticker = mem.ticker AND p.industry = mem.industry) AS n_members
        FROM mem JOIN lead USING (ticker)
        UNION ALL SELECT 'member', class_id, ticker, NULL, NULL FROM classes""",
    "j7_co_exposed": """
        SELECT 'share' AS part, *, NULL::VARCHAR AS other, NULL::BIGINT AS sign, NULL::DOUBLE AS weight,
               NULL::VARCHAR AS other_source FROM shares
        UNION ALL SELECT 'member', NULL, driver, NULL, NULL, NULL, NULL, NULL, ticker, sign, weight, source FROM exposed""",
    "g10_subgraph": """
        SELECT class_id, 'member' AS part, NULL::VARCHAR AS via, ticker, NULL::BIGINT AS sign, NULL::DOUBLE AS confidence,
               NULL::BIGINT AS n FROM classes
        UNION ALL SELECT ticker, 'industry', industry, NULL, NULL, NULL, n_members FROM mem JOIN lead USING (ticker)
               JOIN mem_size USING (industry)
        UNION ALL SELECT v.ticker, CASE relation WHEN '후방' THEN 'upstream' ELSE 'downstream' END,
               from_industry || '>' || v.industry, NULL, NULL, v.confidence, coalesce(n_members, 0)
        FROM vert v JOIN lead USING (ticker) LEFT JOIN mem_size USING (industry)
        UNION ALL SELECT ticker, 'driver', driver, NULL, sign, NULL, CASE sign WHEN 1 THEN n_same ELSE n_opposite END
        FROM (SELECT DISTINCT ticker, driver FROM exposed) JOIN lead USING (ticker) JOIN driver_n USING (driver),
             (SELECT unnest([1, -1])::BIGINT AS sign)""",
    "g5_reachability": """
        SELECT 'route' AS part, ticker AS class_id, NULL::VARCHAR AS ticker, kind, target, prio, via FROM (
            SELECT ticker, 'I' AS kind, industry AS target, from_industry || '→' || relation || '→' || industry AS via,
                   CASE relation WHEN '후방' THEN 0 ELSE 1 END AS prio, -confidence AS k FROM vert
            UNION ALL SELECT ticker, 'I', industry, industry || '→동종', 2, 0 FROM mem
            UNION ALL SELECT ticker, 'D', driver, '동인:' || driver, 3, 0 FROM exposed)
        JOIN lead USING (ticker) QUALIFY row_number() OVER (PARTITION BY ticker, kind, target ORDER BY prio, k, via) = 1
        UNION ALL SELECT 'member', class_id, ticker, NULL, NULL, NULL, NULL FROM classes""",
    "g5_reach_overall": """
        SELECT other AS ticker, via FROM reach JOIN sm_master USING (ticker)
        QUALIFY row_number() OVER (PARTITION BY other ORDER BY market_cap DESC NULLS LAST, ticker, prio, via) = 1""",
    "j12_product_backfill": """
        SELECT e.src, e.dst, e.source, e.origin, CASE WHEN e.product = '' THEN coalesce(p.products, '')
               ELSE e.product END AS product
        FROM (SELECT * FROM map_edge_rows UNION ALL SELECT * FROM disclosed_rows) e
        LEFT JOIN (SELECT ticker, min(products) AS products FROM profile_rows WHERE rn = 1 GROUP BY 1) p ON e.src = 'T:' || p.ticker
        WHERE e.rel = '소속'""",
    "j13_preferred_inherit": """
        SELECT 'T:' || pref AS src, dst, 'preferred' AS source, common AS origin, confidence, product,
               pref_name || '는 ' || common_name || '(' || common
               || ')의 우선주로 같은 회사다. 소속은 본주와 같다.' AS evidence
        FROM prefs JOIN pref_parents ON t = common WHERE substr(common, 5, 1) <> '7'
        QUALIFY row_number() OVER (PARTITION BY pref, dst ORDER BY source || '|' || origin DESC) = 1""",
    "j13_preferred_orphans": """
        SELECT pref AS ticker, pref_name AS name FROM prefs
        WHERE common NOT IN (SELECT t FROM pref_parents)""",
    "c20_split_node": """
        SELECT node, left(node, 1) AS kind, substr(node, 3) AS value FROM (
            SELECT src AS node FROM every_edge UNION SELECT dst FROM every_edge)
        UNION ALL SELECT ticker, 'T', ticker FROM sm_master""",
    "u6_industry_vocabulary": """
        SELECT DISTINCT industry FROM (SELECT industry FROM mem UNION ALL SELECT industry FROM map_rows
            UNION ALL SELECT target FROM map_rows)""",
    "c3_normalize_industry": "SELECT name, norm FROM spoken_norm",
    "c4_resolve_industry": "SELECT name, industry, is_new FROM c4_res",
    "a26_new_industry_counts": """
        SELECT industry, CAST(sum(n) AS BIGINT) AS n FROM c4_res
        JOIN (SELECT name, count(*) AS n FROM spoken GROUP BY 1) USING (name)
        WHERE is_new GROUP BY 1""",
    "c5_alias_suggestions": """
        SELECT fresh, known FROM (SELECT DISTINCT p_name AS fresh FROM part)
        JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS known FROM part)
          ON starts_with(replace(fresh, ' ', ''), known)""",
}
