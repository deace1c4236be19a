"""Registered queries against their DuckDB statement on the smallest shared tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from oracles import all_sql
from tideline.plans import all_queries
from tideline.plans.inputs import TABLES

SF = Path("/root/testdata/sf0.001")
PICKED = ("s6_price_panel", "t1_screen_topn", "t1_screen_suppliers", "a1_market_return", "a5_factor_exposure", "a7_group_gap",
          "j4_name_resolution", "g1_map_edges", "u1_edge_union", "j5_vertical_2hop", "w10_best_lag", "a18_quote_stats",
          "c12_slim_section", "c14_parse_contract", "g4_filing_edges", "a13_score_summary", "g6_chain_levels",
          "g5_reach_overall", "g10_subgraph", "t6_drivers_by_weight", "j8_lagged_self_join", "j3_reindex",
          "g8_cycle_break", "g9_layering_after_break", "g7_transitive_closure", "s12_extraction_source", "s12_extraction_rejects",
          "s13_edge_rejects", "s14_case_source", "s14_case_rejects")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="shared tables not present")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    one = lambda v: (round(v, 5) + 0.0 if not math.isnan(v) else None) if isinstance(v, float) else v
    return sorted([tuple(str(one(r[i])) for i in order) for r in rows])


def test_every_query_has_a_sql_check_or_is_iterative_text():
    """The library's own queries; those of optional parts are held by the tests of these parts."""
    q, o = all_queries(), all_sql()
    assert set(o) <= set(q) <= set(entry_points.queries()) and set(o) <= set(entry_points.oracle_sql())
    assert set(q) - set(o) == {"c24_context_text"}


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, str(SF))
    rel = duck.execute(entry_points.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rel.fetchall(), cols)


def test_what_suppliers_sell_meets_part_once(spark):
    from tideline.plans import relations, texts
    for table in (texts.extracted_items, relations.disclosed_edges):
        read = " ".join(table.__wrapped__(spark, str(SF)).inputFiles())
        assert "supplier_goods" in read and "part.parquet" not in read and "lineitem" not in read


def test_texts_of_quotes_are_dealt_out_once(spark):
    from tideline.plans import texts
    for table, n in ((texts.checked_quotes, 1), (texts.claimed_quotes, 0)):
        plan = table.__wrapped__(spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == n


def test_reports_are_built_where_sections_are_read(spark):
    from tideline.plans import texts
    assert "documents.parquet" in " ".join(texts.sections.__wrapped__(spark, str(SF)).inputFiles())


def test_stored_texts_are_read_after_they_are_dealt_out(spark):
    from tideline.plans import outcomes
    for table in (outcomes.validated, outcomes.validated_cases):
        plan = table.__wrapped__(spark, str(SF))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 1 and "Filter" not in plan
        assert "from_json" not in plan.split("RepartitionByExpression")[1] and "jsontostructs" not in plan.split("RepartitionByExpression")[1].lower()


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
