"""Shared CTEs of the DuckDB checks, and a small composer."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def compose(body: str) -> str:
    """Prefix ``body`` with every CTE it mentions, dependencies first."""
    order: list[str] = []
    open_: set[str] = set()

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in CTES and word not in order and word not in open_:
                open_.add(word)
                need(CTES[word])
                if word not in order:
                    order.append(word)

    need(body)
    if not order:
        return body.strip()
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body.strip()


def r(expr: str, digits: int) -> str:
    """Rounded double without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


PAD6 = "CASE WHEN length({0}) < 6 THEN lpad({0}, 6, '0') ELSE {0} END"
SUPP = PAD6.format("l_suppkey::VARCHAR")
S_TICKER = PAD6.format("s_suppkey::VARCHAR")
BRAND = PAD6.format("regexp_extract(p_brand, '(\\d+)$', 1)")
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def panel_cte(prefix: str, cells: str) -> None:
    """{prefix}_cells(base_date, ticker, close, volume, value) -> {prefix}_cal, {prefix}_panel."""
    cte(f"{prefix}_cells", cells)
    cte(f"{prefix}_cal", f"""
        SELECT base_date, row_number() OVER (ORDER BY base_date) - 1 AS dt_idx,
               row_number() OVER (ORDER BY base_date DESC) - 1 AS age, count(*) OVER () AS n_days
        FROM (SELECT DISTINCT base_date FROM {prefix}_cells)""")
    cte(f"{prefix}_panel", f"""
        SELECT ticker, base_date, dt_idx, age, n_days, close, volume, value
        FROM {prefix}_cells JOIN {prefix}_cal USING (base_date) WHERE close > 0""")
    cte(f"{prefix}_ret", f"""
        SELECT a.ticker, a.base_date, a.dt_idx, a.age, a.n_days, a.close / b.close - 1 AS ret
        FROM {prefix}_panel a JOIN {prefix}_panel b
          ON a.ticker = b.ticker AND b.dt_idx = a.dt_idx - 1""")


panel_cte("sm", f"""
    SELECT {SUPP} AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS base_date,
           sum({CENTS}) / (sum(l_quantity) * 100.0) AS close, sum(l_quantity) AS volume,
           sum({CENTS}) / 100.0 AS value
    FROM lineitem GROUP BY 1, 2""")
cte("brand_trades", f"""
    SELECT {BRAND} AS ticker, p_type, CAST(l_shipdate AS DATE) AS tday, {CENTS} AS cents,
           l_quantity AS qty
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
for _p, _unit in (("bw", "week"), ("bd", "day")):
    panel_cte(_p, f"""
        SELECT ticker, CAST(date_trunc('{_unit}', tday) AS DATE) AS base_date,
               sum(cents) / (sum(qty) * 100.0) AS close, sum(qty) AS volume,
               sum(cents) / 100.0 AS value
        FROM brand_trades GROUP BY 1, 2""")
cte("sm_caps", f"""
    SELECT {SUPP} AS ticker, CAST(sum({CENTS}) AS BIGINT) AS market_cap
    FROM lineitem GROUP BY 1""")
cte("sm_master", f"""
    SELECT {S_TICKER} AS ticker, s_name AS name, r_name AS market, n_name AS sector, market_cap
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN sm_caps ON sm_caps.ticker = {S_TICKER}""")
cte("brand_master", """
    SELECT ticker, 'Brand ' || ltrim(ticker, '0') AS name, CAST(sum(cents) AS BIGINT) AS market_cap
    FROM brand_trades GROUP BY 1""")
cte("sm_members", f"""
    SELECT n_name AS industry, {S_TICKER} AS ticker
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
cte("factor_cells", """
    SELECT CAST(date_trunc('month', tday) AS DATE) AS base_date, p_type AS factor,
           sum(cents) / (sum(qty) * 100.0) AS close
    FROM brand_trades GROUP BY 1, 2""")
cte("nation_flows", f"""
    SELECT sn.n_name AS supplier_nation, cn.n_name AS customer_nation,
           CAST(sum({CENTS}) AS BIGINT) AS cents
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey GROUP BY 1, 2""")
