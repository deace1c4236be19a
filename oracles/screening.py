"""Checks for tideline.plans.screening."""

from oracles.base import BRAND, CENTS, S_TICKER, SUPP, cte, r

cte("raw_codes", """
    SELECT c_custkey, CASE c_mktsegment
        WHEN 'MACHINERY' THEN 'kr7' || lpad(c_custkey::VARCHAR, 6, '0') || '003'
        WHEN 'BUILDING' THEN '  ' || c_custkey || ' '
        WHEN 'AUTOMOBILE' THEN '0' || lpad(c_custkey::VARCHAR, 4, '0') || 'k'
        WHEN 'FURNITURE' THEN 'xx' || c_custkey ELSE c_custkey::VARCHAR END AS raw
    FROM customer""")
cte("clean_codes", """
    SELECT c_custkey, raw, upper(trim(raw)) AS s,
           regexp_matches(upper(trim(raw)), '^KR[A-Z0-9][0-9]{6}[0-9]{3}$') AS std FROM raw_codes""")
cte("code_shapes", """
    SELECT c_custkey, raw, std OR regexp_matches(CASE WHEN regexp_matches(s, '^[0-9]+$')
               AND length(s) < 6 THEN lpad(s, 6, '0') ELSE s END, '^[0-9][0-9A-Z]{5}$') AS good
    FROM clean_codes""")
cte("etf_cells", f"""
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS base_date,
           replace(p_name, ' ', '_') AS ticker, p_name AS name,
           sum({CENTS}) / (sum(l_quantity) * 100.0) AS close
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
cte("etf_panel", """
    SELECT e.*, age FROM etf_cells e JOIN sm_cal USING (base_date) WHERE age < 24 AND close > 0""")
cte("etf_catalog", """
    SELECT DISTINCT ticker, name FROM etf_panel WHERE age = (SELECT min(age) FROM etf_panel)""")
cte("factor_specs", """
    SELECT * FROM (VALUES ('rings', ['small ring', 'ring'], ['red', 'old']),
        ('gears', ['gear'], ['hot']), ('rods', ['cold rod', 'new rod', 'rod'], []::VARCHAR[]),
        ('silk', ['silk'], []::VARCHAR[]), ('widgets', ['widget', 'gizmo'], ['small', 'large']))
    t(factor, keywords, exclude)""")


def signals_cte(p: str) -> None:
    """{p}_sig: last-day signals by positions counted from the end of the panel."""
    full = lambda a, n: (
        f"CASE WHEN count(close) FILTER (age BETWEEN {a} AND {a + n - 1}) = {n} "
        f"THEN avg(close) FILTER (age BETWEEN {a} AND {a + n - 1}) END")
    at = lambda a: f"max(close) FILTER (age = {a})"
    cte(f"{p}_wide", f"""
        SELECT ticker, count(close) AS n_obs, {at(0)} AS c0, {at(5)} AS c5, {at(20)} AS c20,
               {at(60)} AS c60, {full(0, 20)} AS m20, {full(0, 60)} AS m60, {full(7, 20)} AS t20,
               {full(7, 60)} AS t60, {full(10, 60)} AS m60a, {full(30, 60)} AS m60b,
               {full(40, 60)} AS m60c, avg(volume) FILTER (age < 5) AS v0,
               avg(volume) FILTER (age BETWEEN 5 AND 24) AS v1,
               max(close) FILTER (age < 120) AS hi, avg(value) FILTER (age < 20) AS turnover
        FROM {p}_panel GROUP BY ticker""")
    cte(f"{p}_sig", f"""
        SELECT ticker, c0 AS close, c0 / c5 - 1 AS ret5, c0 / c20 - 1 AS ret20,
               c0 / c60 - 1 AS ret60,
               coalesce(m20 > m60, false) AND NOT coalesce(t20 > t60, false) AS golden_cross,
               coalesce(m60 - m60a > 0 AND m60b - m60c < 0, false) AS slope_turn,
               v0 / nullif(v1, 0) AS vol_surge, c0 / hi AS high_proximity,
               turnover AS avg_turnover
        FROM {p}_wide WHERE n_obs >= 60 AND c20 IS NOT NULL AND c0 IS NOT NULL""")
    cte(f"{p}_trig", f"""
        SELECT *, CASE WHEN coalesce(ret20 >= 0.15, false) OR coalesce(high_proximity >= 0.97, false)
                       THEN '강세지속'
                       WHEN (golden_cross OR slope_turn) AND coalesce(vol_surge >= 2.5, false)
                       THEN '상승전환' END AS trigger FROM {p}_sig""")


signals_cte("bw")
signals_cte("sm")


def _screen(p: str, master: str) -> str:
    return f"""
    SELECT * EXCLUDE (pos) FROM ({_ranked(p, master)})"""


def _ranked(p: str, master: str) -> str:
    """The screen with the place of each ticker in it."""
    rank = lambda c: (f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
                      f" / count(*) OVER ()")
    return f"""
    SELECT ticker, name, trigger, CAST(floor(close) AS BIGINT) AS close, {r('ret5', 4)} AS ret5,
           {r('ret20', 4)} AS ret20, {r('ret60', 4)} AS ret60, {r('vol_surge', 2)} AS vol_surge,
           {r('high_proximity', 3)} AS high_proximity, market_cap,
           row_number() OVER (ORDER BY score DESC NULLS LAST, ticker) AS pos
    FROM (SELECT *, {rank('ret20')} + {rank('vol_surge')} + {rank('high_proximity')} AS score
          FROM {p}_trig JOIN {master} USING (ticker)
          WHERE market_cap >= 1000000000 AND avg_turnover >= 10000 AND trigger IS NOT NULL)
    ORDER BY score DESC NULLS LAST, ticker LIMIT 30"""


cte("sm_screen", _ranked("sm", "sm_master"))
SQL = {
    "t11_analysis_quota": f"SELECT ticker, pos FROM ({_ranked('sm', 'sm_master')}) WHERE pos <= 20",
    "s1_snapshot_scan": f"""
        SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS base_date, {SUPP} AS ticker,
               l_linestatus AS market, l_orderkey, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE), l_suppkey ORDER BY
            l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) = 1""",
    "s2_resolve_fields": """
        SELECT l_suppkey AS ticker, count(*) AS n, max(l_extendedprice) AS high,
               sum(l_quantity) AS volume FROM lineitem GROUP BY 1""",
    "s3_numeric_cast": f"""
        SELECT l_returnflag, l_linestatus, count(*) AS n_rows,
               count(*) FILTER (l_returnflag <> 'A') AS n_numbers,
               max(l_extendedprice) FILTER (l_returnflag <> 'A') AS max_price,
               CAST(sum({CENTS}) FILTER (l_returnflag <> 'A') AS BIGINT) AS cents
        FROM lineitem GROUP BY 1, 2""",
    "s4_normalize_ticker": """
        SELECT c_custkey, raw, CASE WHEN std THEN substr(s, 4, 6)
               WHEN length(s) < 6 THEN lpad(s, 6, '0') ELSE s END AS ticker FROM clean_codes""",
    "s5_ticker_quality_gate": """
        SELECT count(*) AS n_rows, count(*) FILTER (NOT good) AS n_odd,
               count(*) FILTER (NOT good) > count(*) * 0.05 AS failed FROM code_shapes""",
    "s5_ticker_rejects": "SELECT c_custkey, raw FROM code_shapes WHERE NOT good",
    "s6_price_panel": f"""
        SELECT ticker, CAST(base_date AS VARCHAR) AS base_date, dt_idx - n_days + 60 AS dt_idx, age,
               CAST(60 AS BIGINT) AS n_days, {r('close', 6)} AS close, volume,
               {r('value', 6)} AS value FROM sm_panel WHERE age < 60""",
    "s7_etf_panel": f"""
        SELECT ticker, c.name, n_closes, {r('high', 6)} AS high FROM (
            SELECT ticker, count(*) AS n_closes, max(close) AS high FROM etf_panel GROUP BY 1) p
        LEFT JOIN etf_catalog c USING (ticker)""",
    "s8_master_from_snapshot": """
        SELECT m.* FROM sm_master m
        WHERE ticker IN (SELECT ticker FROM sm_panel WHERE age = 0)""",
    "s9_factor_proxy": """
        SELECT s.factor, t.ticker, t.name AS proxy_name, t.kw_rank, t.ticker IS NULL AS rejected
        FROM factor_specs s LEFT JOIN (
            SELECT factor, c.ticker, name, list_position(
                       list_transform(keywords, lambda k: contains(name, k)), true)::BIGINT - 1 AS kw_rank,
                   row_number() OVER (PARTITION BY factor ORDER BY list_position(
                       list_transform(keywords, lambda k: contains(name, k)), true), length(name),
                       c.ticker, name) AS rn
            FROM factor_specs, etf_catalog c
            JOIN (SELECT ticker FROM etf_panel GROUP BY 1 HAVING count(*) >= 2) p
              ON p.ticker = c.ticker
            WHERE len(list_filter(exclude, lambda x: contains(name, x))) = 0
              AND len(list_filter(keywords, lambda k: contains(name, k))) > 0) t
        ON t.factor = s.factor AND t.rn = 1""",
    "s10_group_catalog": f"""
        SELECT grp, ticker FROM (
            SELECT DISTINCT '테마:' || industry AS grp, ticker FROM sm_members
            WHERE regexp_matches(ticker, '^[0-9]{{6}}$'))
        QUALIFY count(*) OVER (PARTITION BY grp) >= 3
        UNION ALL
        SELECT grp, ticker FROM (
            SELECT DISTINCT 'ETF:' || p_name AS grp, {BRAND} AS ticker FROM part
            WHERE p_size <> 1 AND p_name NOT LIKE '%red%' AND p_name NOT LIKE '%gear%')
        QUALIFY count(*) OVER (PARTITION BY grp) BETWEEN 5 AND 80""",
    "s15_partition_sink": """
        SELECT CAST(base_date AS VARCHAR) AS base_date, count(*) AS n,
               sum(CASE WHEN age < 3 THEN -volume ELSE volume END) AS volume FROM sm_panel GROUP BY base_date""",
    "w1_daily_return": f"""
        SELECT ticker, p.dt_idx, {r('q.ret', 8)} AS ret
        FROM bw_panel p LEFT JOIN bw_ret q USING (ticker, dt_idx)""",
    "w2_period_return": f"""
        SELECT ticker, {r('ret5', 8)} AS ret5, {r('ret20', 8)} AS ret20, {r('ret60', 8)} AS ret60
        FROM bw_sig""",
    "w3_moving_avg": f"""
        SELECT a.ticker, a.dt_idx,
               {r('CASE WHEN count(b.close) FILTER (b.dt_idx > a.dt_idx - 20) = 20 THEN avg(b.close) FILTER (b.dt_idx > a.dt_idx - 20) END', 6)} AS ma20,
               {r('CASE WHEN count(b.close) = 60 THEN avg(b.close) END', 6)} AS ma60
        FROM sm_panel a JOIN sm_panel b
          ON a.ticker = b.ticker AND b.dt_idx BETWEEN a.dt_idx - 59 AND a.dt_idx
        GROUP BY 1, 2""",
    "w4_golden_cross": "SELECT ticker, golden_cross FROM bw_sig",
    "w5_slope_turn": "SELECT ticker, slope_turn FROM bw_sig",
    "w6_volume_surge": f"SELECT ticker, {r('vol_surge', 8)} AS vol_surge FROM sm_sig",
    "w7_high_proximity": f"""
        SELECT ticker, {r('high_proximity', 8)} AS high_proximity,
               {r('avg_turnover', 4)} AS avg_turnover FROM sm_sig""",
    "w9_pct_rank_avg": f"""
        SELECT p_partkey, CAST(size AS BIGINT) AS size, {r('''CASE WHEN size IS NOT NULL THEN
               (rank() OVER (ORDER BY size NULLS LAST)
                + (count(*) OVER (PARTITION BY size) - 1) / 2.0) / count(size) OVER () END''', 9)}
               AS pct
        FROM (SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_size END AS size FROM part)""",
    "f1_min_history": """
        SELECT ticker, count(*) AS n_obs FROM bd_panel WHERE age < 130 GROUP BY 1
        HAVING count(*) >= 60""",
    "f2_universe_filter": f"""
        SELECT ticker, market_cap, {r('avg_turnover', 4)} AS avg_turnover
        FROM sm_sig JOIN sm_master USING (ticker)
        WHERE market_cap >= 1000000000 AND avg_turnover >= 10000""",
    "f3_trigger_case": "SELECT ticker, trigger FROM sm_trig WHERE trigger IS NOT NULL",
    "j1_signals_with_caps": f"""
        SELECT ticker, name, market_cap, {r('ret20', 8)} AS ret20
        FROM sm_sig JOIN sm_master USING (ticker) WHERE market_cap IS NOT NULL""",
    "t1_screen_topn": _screen("bw", "brand_master"),
    "t1_screen_suppliers": _screen("sm", "sm_master"),
    "t2_universe_by_cap": """
        SELECT ticker, name, market_cap, CAST(floor(round(avg_turnover, 6)) AS BIGINT) AS avg_turnover
        FROM sm_sig JOIN sm_master USING (ticker)
        WHERE market_cap >= 1000000000 AND round(avg_turnover, 6) >= 10000
        ORDER BY market_cap DESC, ticker""",
    "a1_market_return": f"""
        SELECT p.dt_idx, {r('sum(market_cap * ret) / nullif(sum(market_cap) FILTER (ret IS NOT NULL), 0)', 8)} AS ret
        FROM sm_panel p LEFT JOIN sm_ret q USING (ticker, dt_idx) LEFT JOIN sm_caps USING (ticker)
        GROUP BY 1""",
    "a1_market_return_padded": f"""
        SELECT dt_idx, {r('sum(market_cap * ret) / nullif(sum(market_cap) FILTER (ret IS NOT NULL), 0)', 8)} AS ret
        FROM (SELECT ticker, dt_idx, CASE WHEN filled IS NOT NULL THEN
                     filled / lag(filled) OVER (PARTITION BY ticker ORDER BY dt_idx) - 1 END AS ret,
                     filled
              FROM (SELECT t.ticker, 129 - c.age AS dt_idx,
                           last_value(p.close IGNORE NULLS) OVER (
                               PARTITION BY t.ticker ORDER BY c.age DESC
                               ROWS UNBOUNDED PRECEDING) AS filled
                    FROM (SELECT DISTINCT ticker FROM bd_panel) t, bd_cal c
                    LEFT JOIN bd_panel p ON p.ticker = t.ticker AND p.age = c.age
                    WHERE c.age < 130))
        JOIN brand_master USING (ticker) WHERE filled IS NOT NULL GROUP BY 1""",
    "a30_master_quality": """
        SELECT count(*) AS n_rows, count(*) FILTER (sector <> 'NATION_9') AS n_named,
               count(*) FILTER (sector <> 'NATION_9') < count(*) * 0.9 AS warn FROM sm_master""",
}
