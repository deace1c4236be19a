"""Checks for tideline.plans.reporting."""

from oracles.base import cte, r

cte("igraph", """
    SELECT src, dst, rel, source, origin, product, attribution FROM map_edge_rows
    UNION ALL
    SELECT src, dst, rel, 'dart' AS source, origin, product, attribution FROM filing_rows
    QUALIFY row_number() OVER (PARTITION BY src, dst, rel, origin ORDER BY seq DESC) = 1""")
cte("iclaims", """
    SELECT substr(src, 3) AS a, substr(dst, 3) AS b, rel, CASE WHEN origin = '' THEN source ELSE origin END AS who,
           product, attribution FROM igraph WHERE src LIKE 'I:%' AND dst LIKE 'I:%'""")
cte("iflow", """
    SELECT b AS supplier, a AS consumer, count(DISTINCT who) AS n_origins, bool_and(attribution = '추정') AS guessed
    FROM iclaims WHERE rel = '후방' GROUP BY 1, 2""")
cte("iorig", """
    SELECT a AS industry, rel, b AS other, count(DISTINCT who) AS n_origins FROM iclaims GROUP BY 1, 2, 3""")
cte("imem", """
    SELECT DISTINCT substr(dst, 3) AS industry, substr(src, 3) AS ticker FROM igraph WHERE rel = '소속'""")
cte("peeled", """
    SELECT 0 AS step, list({'s': supplier, 'c': consumer}) AS live, []::STRUCT(s VARCHAR, c VARCHAR)[] AS cut
    FROM iflow WHERE supplier <> consumer
    UNION ALL
    SELECT step + 1, list_filter(live, lambda e: NOT list_contains(gone, e.s) AND NOT list_contains(gone, e.c)),
           CASE WHEN len(ends) > 0 THEN cut ELSE list_concat(cut, list_filter(live, lambda e: e.c = gone[1])) END
    FROM (SELECT *, CASE WHEN len(ends) > 0 THEN ends ELSE [list_sort(list_transform(nodes, lambda n: {
                     'k': len(list_filter(ins, lambda x: x = n)) - len(list_filter(outs, lambda x: x = n)), 'n': n}))[1].n]
                 END AS gone
          FROM (SELECT *, list_filter(nodes, lambda n: NOT list_contains(outs, n) OR NOT list_contains(ins, n)) AS ends
                FROM (SELECT *, list_distinct(list_concat(outs, ins)) AS nodes
                      FROM (SELECT *, list_transform(live, lambda e: e.s) AS outs, list_transform(live, lambda e: e.c) AS ins
                            FROM peeled WHERE len(live) > 0))))""")
cte("cuts", "SELECT e.s AS supplier, e.c AS consumer FROM (SELECT unnest(arg_max(cut, step)) AS e FROM peeled)")
cte("dag", """
    SELECT supplier, consumer FROM iflow WHERE supplier <> consumer
    AND (supplier, consumer) NOT IN (SELECT (supplier, consumer) FROM cuts)""")
cte("trade_rows", """
    SELECT 'T:' || CASE WHEN rn = 1 THEN ticker ELSE other END AS src, 'T:' || CASE WHEN rn = 1 THEN other ELSE ticker END AS dst,
           products AS product, CAST(NULL AS DOUBLE) AS weight, 'profile' AS source, ticker AS origin,
           rn::VARCHAR || other_name AS seq FROM profile_rows WHERE other IS NOT NULL AND other <> ticker
    UNION ALL SELECT 'T:' || CASE WHEN rn = 1 THEN ticker ELSE other END, 'T:' || CASE WHEN rn = 1 THEN other ELSE ticker END,
           what, round(weight, 4), 'dart', ticker, rn::VARCHAR || lpad(num, 8, '0') FROM deal_hits WHERE other <> ticker
    UNION ALL SELECT 'T:' || stock_code, 'T:' || buyer, product, weight, 'contract', stock_code,
           rcept_dt || '|' || rcept_no FROM deals WHERE buyer IS NOT NULL AND buyer <> stock_code""")
cte("trades", """
    SELECT * FROM trade_rows
    QUALIFY row_number() OVER (PARTITION BY src, dst, source, origin ORDER BY seq DESC) = 1""")

_LV = """
    SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY k, n, node) AS rank FROM (
        SELECT f.seed, o.other AS node, min(f.rank) AS k, arg_min(-o.n_origins, (f.rank, -o.n_origins)) AS n
        FROM {0} f JOIN iorig o ON o.industry = f.node AND o.rel = '후방'
        WHERE (f.seed, o.other) NOT IN (SELECT (seed, node) FROM {1}) GROUP BY 1, 2)
    QUALIFY rank <= {2}"""
cte("lv0", "SELECT DISTINCT industry AS seed, industry AS node, 1 AS rank FROM iorig")
cte("lv1", _LV.format("lv0", "lv0", 5))
cte("seen1", "SELECT seed, node FROM lv0 UNION ALL SELECT seed, node FROM lv1")
cte("lv2", _LV.format("lv1", "seen1", 4))
cte("seen2", "SELECT seed, node FROM seen1 UNION ALL SELECT seed, node FROM lv2")
cte("lv3", _LV.format("lv2", "seen2", 3))
_DOWN = _LV.replace("후방", "전방")
cte("dn1", _DOWN.format("lv0", "lv0", 5))
cte("seen_dn1", "SELECT seed, node FROM lv0 UNION ALL SELECT seed, node FROM dn1")
cte("dn2", _DOWN.format("dn1", "seen_dn1", 4))
cte("seen_dn2", "SELECT seed, node FROM seen_dn1 UNION ALL SELECT seed, node FROM dn2")
cte("dn3", _DOWN.format("dn2", "seen_dn2", 3))

SQL = {
    "a24_flow_edges": "SELECT supplier, consumer, n_origins, guessed FROM iflow",
    "g16_flow_label": """
        SELECT supplier, consumer, arg_min(p, (inc, NOT ins, length(p), p)) AS label FROM (
            SELECT *, len(list_filter(string_split(consumer, ' '), lambda t: length(t) >= 2 AND contains(p, t))) > 0 AS inc,
                   len(list_filter(string_split(supplier, ' '), lambda t: length(t) >= 2 AND contains(p, t))) > 0 AS ins
            FROM (SELECT CASE rel WHEN '후방' THEN b ELSE a END AS supplier, CASE rel WHEN '후방' THEN a ELSE b END AS consumer,
                         product AS p FROM iclaims WHERE product <> '')) GROUP BY 1, 2""",
    "g11_orphan_industries": """
        SELECT DISTINCT industry FROM imem WHERE industry NOT IN (SELECT supplier FROM iflow)
        AND industry NOT IN (SELECT consumer FROM iflow)""",
    "g6_chain_levels": """
        SELECT seed, 1::BIGINT AS level, rank, node FROM lv1 UNION ALL SELECT seed, 2, rank, node FROM lv2
        UNION ALL SELECT seed, 3, rank, node FROM lv3""",
    "t10_chain_levels": """
        SELECT seed, 1::BIGINT AS level, rank, node FROM dn1 UNION ALL SELECT seed, 2, rank, node FROM dn2
        UNION ALL SELECT seed, 3, rank, node FROM dn3""",
    "a19_trade_rollup": """
        SELECT substr(src, 3) AS seller, substr(dst, 3) AS buyer, arg_min(product, (-length(product), product)) AS product,
               max(weight)::DOUBLE AS weight FROM trades GROUP BY 1, 2""",
    "a20_cross_validation": """
        SELECT (SELECT count(*) FROM (SELECT industry FROM imem UNION SELECT industry FROM iorig)) AS n_industries,
               (SELECT count(DISTINCT ticker) FROM imem) AS n_stocks, (SELECT count(*) FROM iorig) AS n_relations,
               (SELECT count(*) FROM iorig WHERE rel = '후방' AND n_origins >= 2) AS n_cross""",
    "a20_relation_origins": "SELECT industry, rel, other, n_origins FROM iorig",
    "t12_industry_rank": """
        SELECT industry, coalesce(m, 0) AS n_members, coalesce(u, 0) AS n_up, coalesce(d, 0) AS n_down,
               2 * coalesce(m, 0) + coalesce(u, 0) + coalesce(d, 0) AS score
        FROM (SELECT industry, count(*) AS m FROM imem GROUP BY 1) FULL JOIN (
            SELECT industry, count(*) FILTER (rel = '후방') AS u, count(*) FILTER (rel = '전방') AS d FROM iorig
            GROUP BY 1) USING (industry)""",
    "t12_top_neighbours": """
        SELECT industry, rel, other, n_origins, row_number() OVER (
            PARTITION BY industry, rel ORDER BY n_origins DESC, other) AS rank FROM iorig QUALIFY rank <= 4""",
    "a25_industry_makes": """
        SELECT substr(dst, 3) AS industry, substr(src, 3) AS ticker, max(product) <> '' AS has_product,
               coalesce(string_agg(DISTINCT nullif(product, ''), ' · ' ORDER BY nullif(product, '')), '') AS products
        FROM igraph WHERE rel = '소속' GROUP BY 1, 2""",
    "u7_search_index": """
        SELECT 'i' AS kind, industry AS name, NULL::VARCHAR AS industry FROM (
            SELECT industry FROM imem UNION SELECT industry FROM iorig)
        UNION ALL SELECT DISTINCT 's', coalesce(name, ticker), industry FROM imem LEFT JOIN sm_master USING (ticker)""",
    "t5_members_by_cap": """
        SELECT industry, rank, ticker, market_cap, greatest(n - 8, 0) AS others FROM (
            SELECT industry, ticker, market_cap, count(*) OVER (PARTITION BY industry) AS n, row_number() OVER (
                PARTITION BY industry ORDER BY coalesce(market_cap, 0) DESC, ticker) AS rank
            FROM imem LEFT JOIN sm_master USING (ticker)) WHERE rank <= 8""",
    "t6_drivers_by_weight": """
        SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY abs(coalesce(my_weight, 0)) DESC, driver, source)
               AS rank, driver, my_sign, my_weight, n_same, n_opposite FROM shares QUALIFY rank <= 6""",
    "a21_kpi_row": f"""
        SELECT (SELECT count(*) FROM sm_screen) AS n_candidates, (SELECT count(*) FROM good_cases) AS n_ideas,
               {r('(SELECT greatest(coalesce(max(gap), 0), 0) FROM gaps)', 6)} AS max_gap,
               (SELECT count(DISTINCT grp) FROM gaps) AS n_groups, (SELECT count(*) FROM every_edge) AS n_edges,
               (SELECT count(*) FROM bens_marked WHERE graph_backed) AS graph_backed,
               (SELECT count(*) FROM bens_marked) AS n_marked""",
    "a22_coverage_report": """
        SELECT DISTINCT 'map' AS kind, map_file AS origin, company AS name FROM map_rows JOIN map_resolved USING (company)
        WHERE ticker IS NULL
        UNION ALL SELECT DISTINCT 'analysis', shape, name FROM bens_ann WHERE ticker IS NULL""",
}
SQL["g9_layering"] = """
    SELECT node, layer - min(layer) OVER () AS layer FROM (
        SELECT d.node, CASE WHEN d.node NOT IN (SELECT consumer FROM dag) THEN n.near ELSE d.depth END AS layer
        FROM node_depth d LEFT JOIN (
            SELECT supplier AS node, min(depth) - 1 AS near FROM dag JOIN node_depth ON node = consumer GROUP BY 1) n
        USING (node))"""
cte("walk", """
    SELECT node, depth FROM (SELECT supplier AS node, 0::BIGINT AS depth FROM dag
        UNION SELECT consumer, 0::BIGINT FROM dag)
    UNION SELECT consumer, depth + 1 FROM walk JOIN dag ON supplier = node""")
cte("node_depth", "SELECT node, max(depth) AS depth FROM walk GROUP BY 1")
cte("downs", """
    SELECT supplier AS node, consumer AS below FROM dag
    UNION SELECT downs.node, consumer FROM downs JOIN dag ON supplier = below""")
SQL["g8_cycle_break"] = "SELECT supplier, consumer FROM cuts"
cte("placed", SQL["g9_layering"])
SQL["g9_layering_after_break"] = """
    SELECT node, layer, coalesce(n_back, 0) AS n_back FROM placed LEFT JOIN (
        SELECT supplier AS node, count(*) AS n_back FROM cuts JOIN placed a ON a.node = supplier
        JOIN placed b ON b.node = consumer WHERE b.layer <= a.layer GROUP BY 1) USING (node)"""
SQL["g7_transitive_closure"] = "SELECT node, below FROM downs"
