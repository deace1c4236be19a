"""Checks for tideline.plans.leadlag: lags by joining long series on shifted positions."""

from oracles.base import BRAND, CENTS, cte, r

cte("nat_raw", """
    SELECT industry AS name, dt_idx, sum(market_cap * ret) / sum(market_cap) AS ret
    FROM sm_members JOIN sm_ret USING (ticker) JOIN sm_caps USING (ticker)
    GROUP BY 1, 2 HAVING count(*) >= 2""")
cte("sm_mkt0", "SELECT dt_idx, coalesce(m, 0.0) AS m FROM sm_cal LEFT JOIN sm_mkt USING (dt_idx)")
cte("nat_series", """
    SELECT s.name, dt_idx, ret - CASE WHEN n >= 60 THEN cov / (SELECT var_pop(m) FROM sm_mkt0) ELSE 0 END * m AS ret
    FROM nat_raw s JOIN sm_mkt0 USING (dt_idx)
    JOIN (SELECT name, count(*) AS n, covar_pop(ret, m) AS cov FROM nat_raw JOIN sm_mkt0 USING (dt_idx)
          GROUP BY 1) b ON b.name = s.name""")
cte("nat_pairs", """
    SELECT DISTINCT least(customer_nation, supplier_nation) AS a,
           greatest(customer_nation, supplier_nation) AS b FROM strong_flows""")


def lags(name: str, pairs: str, series: str, top: int) -> None:
    cte(name, f"""
        SELECT a, b, lag, count(*) AS n, corr(x.ret, y.ret) AS corr
        FROM {pairs} JOIN {series} x ON x.name = a
        CROSS JOIN (SELECT unnest(range({-top}, {top + 1})) AS lag)
        JOIN {series} y ON y.name = b AND y.dt_idx = x.dt_idx + lag
        GROUP BY 1, 2, 3""")


def best(src: str, min_obs: int) -> str:
    t = ("abs(corr) * sqrt(n - 2) / sqrt(1 - least(abs(corr), 0.999999) ** 2)")
    return f"""
        SELECT a, b, lag, corr, n FROM {src} WHERE n >= {min_obs} AND corr IS NOT NULL AND NOT isnan(corr)
        QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY {t} DESC, abs(lag), lag) = 1"""


lags("nat_lags", "nat_pairs", "nat_series", 20)
cte("nat_best", best("nat_lags", 60))
cte("all_nat_pairs", """
    SELECT x.name AS a, y.name AS b FROM (SELECT DISTINCT name FROM nat_series) x
    JOIN (SELECT DISTINCT name FROM nat_series) y ON x.name < y.name""")
lags("all_nat_lags", "all_nat_pairs", "nat_series", 20)
cte("all_nat_best", best("all_nat_lags", 60))
cte("nat_found", """
    SELECT a, b, lag, corr, n FROM all_nat_best, (SELECT count(*) AS k FROM all_nat_pairs)
    WHERE abs(corr) >= least(0.99, tanh((2.575 + sqrt(ln(k))) / sqrt(n - 3)))
      AND (a, b) NOT IN (SELECT (a, b) FROM nat_pairs)""")
cte("scored", f"""
    SELECT src, dst, rel, {r('corr', 3)} AS price_corr,
           CASE WHEN src < dst THEN lag ELSE -lag END AS price_lag, n AS price_obs, evidence
    FROM map_edge_rows LEFT JOIN nat_best
      ON a = least(substr(src, 3), substr(dst, 3)) AND b = greatest(substr(src, 3), substr(dst, 3))
     AND src LIKE 'I:%'""")
cte("band_rev", f"""
    SELECT {BRAND} AS ticker, p_type || ' ' || ((p_size - 1) // 10) AS industry,
           CAST(sum({CENTS}) AS BIGINT) AS rev FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY 1, 2""")
cte("band_members", """
    SELECT industry, ticker FROM band_rev JOIN (SELECT ticker, sum(rev) AS total, count(*) AS n
        FROM band_rev GROUP BY 1) USING (ticker) WHERE rev * n >= total""")
cte("band_raw", """
    SELECT industry AS name, dt_idx, sum(market_cap * ret) / sum(market_cap) AS ret
    FROM band_members JOIN bd_ret USING (ticker) JOIN brand_master USING (ticker)
    GROUP BY 1, 2 HAVING count(*) >= 2""")
cte("bd_mkt0", """
    SELECT dt_idx, coalesce(m, 0.0) AS m FROM bd_cal LEFT JOIN (
        SELECT dt_idx, sum(market_cap * ret) / sum(market_cap) AS m
        FROM bd_ret JOIN brand_master USING (ticker) GROUP BY 1) USING (dt_idx)""")
cte("band_series", """
    SELECT s.name, dt_idx, ret - CASE WHEN n >= 60 THEN cov / (SELECT var_pop(m) FROM bd_mkt0) ELSE 0 END * m AS ret
    FROM band_raw s JOIN bd_mkt0 USING (dt_idx)
    JOIN (SELECT name, count(*) AS n, covar_pop(ret, m) AS cov FROM band_raw JOIN bd_mkt0 USING (dt_idx)
          GROUP BY 1) b ON b.name = s.name""")
cte("band_days", """
    SELECT dt_idx, blk, max(dt_idx) OVER (PARTITION BY blk) AS label, n // 21 - 1 - blk AS pos FROM (
        SELECT dt_idx, (row_number() OVER (ORDER BY dt_idx DESC) - 1) // 21 AS blk, count(*) OVER () AS n
        FROM (SELECT DISTINCT dt_idx FROM band_series)) WHERE blk < n // 21""")
cte("band_blocks", """
    SELECT name, pos AS dt_idx, label, sum(ret) AS ret FROM band_series JOIN band_days USING (dt_idx)
    GROUP BY 1, 2, 3 HAVING count(*) >= 10""")
cte("band_pairs", """
    SELECT a, b, (SELECT count(*) FROM band_members x JOIN band_members y USING (ticker)
                  WHERE x.industry = a AND y.industry = b) AS common_n
    FROM (SELECT DISTINCT x.industry AS a, y.industry AS b FROM band_members x JOIN band_members y
          ON split_part(x.industry, ' ', 1) = split_part(y.industry, ' ', 1)
         AND right(y.industry, 1)::INT - right(x.industry, 1)::INT IN (1, 2))""")
cte("band_overlap", """
    SELECT a, b, common_n / (ka + kb - common_n) AS overlap FROM band_pairs
    JOIN (SELECT industry AS a, count(*) AS ka FROM band_members GROUP BY 1) USING (a)
    JOIN (SELECT industry AS b, count(*) AS kb FROM band_members GROUP BY 1) USING (b)""")
cte("band_pos", """
    SELECT o.a, o.b, d.dt_idx, row_number() OVER (PARTITION BY o.a, o.b ORDER BY d.dt_idx) AS p,
           x.ret AS xr, y.ret AS yr
    FROM band_overlap o CROSS JOIN (SELECT DISTINCT dt_idx FROM band_blocks) d
    LEFT JOIN band_blocks x ON x.name = o.a AND x.dt_idx = d.dt_idx
    LEFT JOIN band_blocks y ON y.name = o.b AND y.dt_idx = d.dt_idx
    WHERE o.overlap < 0.5 AND (x.ret IS NOT NULL OR y.ret IS NOT NULL)""")
cte("band_lags", """
    SELECT x.a, x.b, lag, count(*) AS n, corr(x.xr, y.yr) AS corr
    FROM band_pos x CROSS JOIN (SELECT unnest(range(-18, 19)) AS lag)
    JOIN band_pos y ON y.a = x.a AND y.b = x.b AND y.p = x.p + lag
    WHERE x.xr IS NOT NULL AND y.yr IS NOT NULL GROUP BY 1, 2, 3""")
cte("band_best", best("band_lags", 24))
cte("cycles", """
    SELECT a, b, overlap, lag, corr, n, NULL::VARCHAR AS skipped FROM band_best JOIN band_overlap USING (a, b)
    UNION ALL SELECT a, b, overlap, NULL, NULL, NULL, '구성 중복' FROM band_overlap
    WHERE overlap >= 0.5 AND a IN (SELECT name FROM band_blocks) AND b IN (SELECT name FROM band_blocks)""")
cte("cycles2", """
    SELECT a, b, overlap, lag, corr, n, skipped, false AS mirrored FROM cycles
    UNION ALL SELECT b, a, overlap, -lag, corr, n, skipped, true FROM cycles""")

SQL = {
    "a8_residualize": f"SELECT name, dt_idx, {r('ret', 8)} AS ret FROM nat_series",
    "a9_lag_corr": f"SELECT a, b, lag, n, {r('corr', 7)} AS corr FROM nat_lags WHERE n >= 60",
    "j8_lagged_self_join": f"SELECT a, b, lag, n, CASE WHEN NOT isnan(corr) THEN {r('corr', 7)} END AS corr FROM nat_lags",
    "w10_best_lag": f"SELECT a, b, lag, {r('corr', 7)} AS corr, n FROM nat_best",
    "c18_corr_t": f"""
        SELECT src, dst, {r('abs(price_corr) * sqrt(price_obs - 2) / sqrt(1 - price_corr ** 2)', 7)} AS t
        FROM scored WHERE price_corr IS NOT NULL""",
    "c19_corr_threshold": f"""
        SELECT DISTINCT price_obs, {r('least(0.99, tanh((2.575 + sqrt(ln(k))) / sqrt(price_obs - 3)))', 9)}
               AS threshold
        FROM scored, (SELECT count(*) AS k FROM scored WHERE price_obs IS NOT NULL)
        WHERE price_obs IS NOT NULL""",
    "g12_edge_price_score": "SELECT src, dst, rel, price_corr, price_lag, price_obs FROM scored",
    "f5_weak_edge_queue": """
        SELECT src, dst, rel, 'valuechain' AS source, '' AS origin, price_corr, price_obs,
               evidence FROM scored WHERE abs(price_corr) < 0.3""",
    "j9_unlinked_pairs": f"SELECT a, b, lag, {r('corr', 6)} AS corr, n FROM nat_found",
    "t7_discovery_topn": f"""
        SELECT a, b, lag, {r('corr', 3)} AS corr, n FROM nat_found ORDER BY abs(nat_found.corr) DESC, a, b LIMIT 40""",
    "a10_monthly_blocks": f"SELECT name, dt_idx AS pos, label, {r('ret', 8)} AS ret FROM band_blocks",
    "a11_member_jaccard": f"SELECT a, b, {r('overlap', 9)} AS overlap FROM band_overlap",
    "g13_cycle_lags": f"""
        SELECT a, b, {r('overlap', 4)} AS overlap, lag, {r('corr', 6)} AS corr, n, skipped, mirrored
        FROM cycles2""",
    "u5_pair_dedupe": """
        SELECT a, b, lag, n, false AS mirrored FROM nat_best
        UNION ALL SELECT b, a, -lag, n, true FROM nat_best""",
    "j14_cycle_lag_attach": f"""
        SELECT 'I:' || p.a AS src, 'I:' || p.b AS dst, rel, lag AS cycle_lag_months,
               {r('corr', 3)} AS cycle_corr
        FROM (SELECT a, b, '전방' AS rel FROM band_pairs UNION ALL SELECT b, a, '후방' FROM band_pairs) p
        LEFT JOIN cycles2 c ON c.a = p.a AND c.b = p.b""",
    "t8_lag_table_topn": f"""
        SELECT a, b, lag, {r('corr', 6)} AS corr, n FROM cycles2 WHERE NOT mirrored AND lag IS NOT NULL
        ORDER BY abs(cycles2.corr) DESC, a, b LIMIT 12""",
}
