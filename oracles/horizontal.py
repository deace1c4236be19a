"""Checks for tideline.plans.horizontal: residual series are built row by row on a dense grid."""

from oracles.base import cte, r

cte("sm_mkt", """
    SELECT dt_idx, sum(market_cap * ret) / sum(market_cap) AS m
    FROM sm_ret JOIN sm_caps USING (ticker) GROUP BY 1""")
cte("grp_members", """
    SELECT grp, ticker FROM (
        SELECT '산업:' || sector AS grp, ticker FROM sm_master WHERE market_cap IS NOT NULL
        UNION ALL SELECT '테마:' || market, ticker FROM sm_master WHERE market_cap IS NOT NULL)
    QUALIFY count(*) OVER (PARTITION BY grp) >= 3""")
cte("grp_ret", """
    SELECT grp, dt_idx, avg(ret) AS ret, count(*) AS n_obs FROM grp_members JOIN sm_ret USING (ticker)
    GROUP BY 1, 2 HAVING count(*) >= 3""")
cte("win", "SELECT greatest(20, least(120, max(n_days) - 1)) AS w FROM sm_cal")
cte("win_days", """
    SELECT dt_idx, coalesce(m, 0.0) AS m FROM sm_cal LEFT JOIN sm_mkt USING (dt_idx), win
    WHERE age < w""")
cte("fac_ret", """
    SELECT factor, dt_idx, f FROM (
        SELECT factor, dt_idx, close / lag(close) OVER (PARTITION BY factor ORDER BY dt_idx) - 1 AS f
        FROM factor_cells JOIN sm_cal USING (base_date)) WHERE f IS NOT NULL""")
cte("grid", """
    SELECT t.ticker, d.dt_idx, d.m, coalesce(q.ret, 0.0) AS y
    FROM (SELECT ticker FROM sm_ret JOIN win_days USING (dt_idx), win
          GROUP BY ticker, w HAVING count(*) >= w * 0.8) t
    CROSS JOIN win_days d LEFT JOIN sm_ret q ON q.ticker = t.ticker AND q.dt_idx = d.dt_idx""")
cte("mbeta", "SELECT ticker, regr_slope(y, m) AS bm FROM grid GROUP BY 1")
cte("fac_resid", """
    SELECT factor, dt_idx, f - fb * m AS e FROM fac_ret JOIN win_days USING (dt_idx)
    JOIN (SELECT factor, regr_slope(f, m) AS fb, count(*) AS n FROM fac_ret
          JOIN win_days USING (dt_idx) GROUP BY 1) USING (factor), win WHERE n >= w * 0.8""")
cte("expo", """
    SELECT ticker, factor, regr_slope(y - bm * m, e) AS beta, corr(y - bm * m, e) AS corr
    FROM grid JOIN mbeta USING (ticker) JOIN fac_resid USING (dt_idx)
    GROUP BY 1, 2 HAVING abs(corr(y - bm * m, e)) >= 0.1""")
cte("fac_moves", """
    SELECT factor, sum(f) FILTER (rn <= 5) AS ret5, sum(f) FILTER (rn <= 20) AS ret20 FROM (
        SELECT factor, f, row_number() OVER (PARTITION BY factor ORDER BY dt_idx DESC) AS rn,
               count(*) OVER (PARTITION BY factor) AS n
        FROM fac_ret JOIN win_days USING (dt_idx)), win WHERE n >= w * 0.8 GROUP BY 1""")
cte("ghist", """
    SELECT grp, dt_idx, g, m, pos, count(*) OVER (PARTITION BY grp) AS n FROM (
        SELECT grp, dt_idx, ret AS g, coalesce(m, 0.0) AS m,
               row_number() OVER (PARTITION BY grp ORDER BY dt_idx DESC) - 1 AS pos
        FROM grp_ret LEFT JOIN sm_mkt USING (dt_idx)), win
    WHERE pos < w QUALIFY count(*) OVER (PARTITION BY grp) >= w * 0.8""")
cte("gresid", """
    SELECT h.*, g - gb * m AS e FROM ghist h
    JOIN (SELECT grp, regr_slope(g, m) AS gb FROM ghist GROUP BY 1) USING (grp)""")
cte("gmove", """
    SELECT grp, sum(e) AS recent_g, sum(m) AS recent_m FROM gresid WHERE pos < 5 GROUP BY 1
    HAVING abs(sum(e)) >= 0.02""")
cte("ggrid", """
    SELECT h.grp, gm.ticker, h.dt_idx, h.m, h.e, q.ret, coalesce(q.ret, 0.0) AS y, h.n
    FROM gresid h JOIN gmove USING (grp) JOIN grp_members gm ON gm.grp = h.grp
    LEFT JOIN sm_ret q ON q.ticker = gm.ticker AND q.dt_idx = h.dt_idx""")
cte("gfit", """
    SELECT grp, ticker, bm, regr_slope(y - bm * m, e) AS beta, corr(y - bm * m, e) AS corr
    FROM ggrid JOIN (SELECT grp, ticker, regr_slope(y, m) AS bm FROM ggrid GROUP BY grp, ticker
                     HAVING count(ret) >= max(n) * 0.8) USING (grp, ticker)
    GROUP BY ALL HAVING corr(y - bm * m, e) >= 0.3""")
cte("gaps", """
    SELECT grp, recent_g AS group_move, ticker, beta, corr, bm * recent_m + beta * recent_g AS expected,
           actual, bm * recent_m + beta * recent_g - actual AS gap
    FROM gfit JOIN gmove USING (grp)
    JOIN (SELECT ticker, sum(ret) AS actual FROM sm_ret WHERE age < 5 GROUP BY 1
          HAVING count(*) >= 3) USING (ticker)""")

_GAP_COLS = ", ".join(f"{r(c, 6)} AS {c}" for c in
                      ("group_move", "beta", "corr", "expected", "actual", "gap"))

SQL = {
    "a2_group_return": f"SELECT grp, dt_idx, {r('ret', 8)} AS ret, n_obs FROM grp_ret",
    "a3_industry_return": f"""
        SELECT industry, dt_idx, {r('sum(market_cap * ret) / sum(market_cap)', 8)} AS ret,
               count(*) AS n_obs
        FROM sm_members JOIN sm_ret USING (ticker) JOIN sm_caps USING (ticker)
        GROUP BY 1, 2 HAVING count(*) >= 2""",
    "a4_beta_corr": f"""
        SELECT ticker, n, n_obs, {r('beta', 7)} AS beta, {r('corr', 7)} AS corr FROM (
            SELECT t.ticker, count(*) AS n, count(q.ret) AS n_obs,
                   regr_slope(coalesce(q.ret, 0.0), m) AS beta, corr(coalesce(q.ret, 0.0), m) AS corr
            FROM (SELECT DISTINCT ticker FROM sm_ret) t CROSS JOIN sm_mkt d
            LEFT JOIN sm_ret q ON q.ticker = t.ticker AND q.dt_idx = d.dt_idx GROUP BY 1)
        WHERE n_obs >= n * 0.8""",
    "a5_factor_exposure": f"""
        SELECT ticker, factor, {r('beta', 6)} AS beta, {r('corr', 6)} AS corr FROM expo""",
    "a5_market_beta": f"SELECT ticker, {r('bm', 6)} AS market_beta FROM mbeta",
    "a6_factor_move": f"""
        SELECT factor, {r('ret5', 8)} AS ret5, {r('ret20', 8)} AS ret20 FROM fac_moves""",
    "a7_group_gap": f"SELECT grp, ticker, {_GAP_COLS} FROM gaps",
    "a12_best_gap": f"""
        SELECT ticker, grp, {_GAP_COLS} FROM gaps
        QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY gap DESC, grp) = 1""",
    "t3_group_peers": f"""
        SELECT a.ticker AS of, b.grp, row_number() OVER (PARTITION BY a.ticker, b.grp
                   ORDER BY b.gap DESC, b.ticker) AS rank, b.ticker, {r('b.gap', 6)} AS gap,
               b.gap > 0.03 AS unreacted
        FROM gaps a JOIN gaps b ON a.grp = b.grp AND a.ticker <> b.ticker
        QUALIFY row_number() OVER (PARTITION BY a.ticker, b.grp ORDER BY b.gap DESC, b.ticker) <= 6""",
    "t4_top_groups": f"""
        SELECT grp, {r('group_move', 6)} AS group_move, rank, ticker, {r('gap', 6)} AS gap FROM (
            SELECT *, dense_rank() OVER (ORDER BY abs(group_move) DESC, grp) AS gr,
                   row_number() OVER (PARTITION BY grp ORDER BY gap DESC, ticker) AS rank FROM gaps)
        WHERE gr <= 8 AND rank <= 6""",
    "t9_factor_rank": f"""
        SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY abs(corr) DESC, factor) AS rank,
               factor, {r('corr', 6)} AS corr, {r('ret5', 6)} AS ret5
        FROM expo LEFT JOIN fac_moves USING (factor)""",
    "j2_align_dates": """
        SELECT factor, count(*) AS n_common, min(dt_idx) AS first, max(dt_idx) AS last
        FROM fac_ret JOIN sm_mkt USING (dt_idx) GROUP BY 1""",
    "j3_reindex": f"""
        SELECT dt_idx, grp, {r('g.ret', 8)} AS ret
        FROM sm_cal CROSS JOIN (SELECT DISTINCT grp FROM grp_ret) LEFT JOIN grp_ret g USING (dt_idx, grp)""",
    "u2_group_union": "SELECT grp, ticker FROM grp_members",
    "a28_inverse_membership": """
        SELECT ticker, string_agg(grp, '|' ORDER BY grp) AS groups FROM grp_members GROUP BY 1""",
}
