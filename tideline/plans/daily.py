"""The runs a user starts: daily, slow lead/lag, inference, report, scoring.

Inputs are DataFrames in the documented shapes; outputs are DataFrames, and ``save_run`` stores them
by date. Tables that several steps read are staged once in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import chains as Ch
from tideline.operators import disclosures as D
from tideline.operators import factors as X
from tideline.operators import graph as R
from tideline.operators import groups as G
from tideline.operators import inference as V
from tideline.operators import leadlag as L
from tideline.operators import market as M
from tideline.operators import names as NM
from tideline.operators import quotient as Cl
from tideline.operators import reports as T
from tideline.operators import scoring as K
from tideline.operators import signals as sig
from tideline.plans.shared import Run, new_run, staged
from tideline.settings import Settings
from tideline.sources import panel as P
from tideline.sources.records import save_by_date


@dataclass
class Inputs:
    """What a daily run reads. Optional inputs add evidence when present.

    snapshots        (base_date, ticker, name, market, sector, close, volume, value, market_cap); with a
                     column ``pos`` the first row of a (day, ticker) wins; with ``code`` in place of
                     ``ticker`` codes are normalized, and too many odd ones stop the run
    maps             (map_file, industry, block, segment, company)
    etf_snapshots    (base_date, ticker, name, close); factor_specs (factor, keywords, exclude)
    group_listing    (kind, name, ticker)
    profiles         (ticker, side, other_name, products, source)
    extractions      (ticker, side, pos, industry, share, tier, what, segment, quote)
    sections         (ticker, text, report_nm, rcept_dt); aliases, counterparty_aliases (alias, target)
    contracts        (rcept_no, report_nm, rcept_dt, corp_name, stock_code, text)
    persistent       edges of earlier runs; cycle_lags the table of the slow run
    """
    snapshots: DataFrame
    maps: DataFrame
    etf_snapshots: DataFrame | None = None
    factor_specs: DataFrame | None = None
    group_listing: DataFrame | None = None
    profiles: DataFrame | None = None
    extractions: DataFrame | None = None
    sections: DataFrame | None = None
    aliases: DataFrame | None = None
    counterparty_aliases: DataFrame | None = None
    contracts: DataFrame | None = None
    persistent: DataFrame | None = None
    cycle_lags: DataFrame | None = None


def _pairs(spark, df: DataFrame | None) -> DataFrame:
    return df if df is not None else spark.createDataFrame([], "alias string, target string")


def gated_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots with normalized tickers and one row per (day, ticker)."""
    if "ticker" not in snapshots.columns:
        snapshots = P.gate_codes(snapshots, "code").drop("code")
    return P.first_per_ticker(snapshots, ["pos"]).drop("pos") if "pos" in snapshots.columns else snapshots


def filing_edges(inputs: Inputs, edges: DataFrame, asof: str, run: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(edges of verified filing items, reject tables)."""
    spark = edges.sparkSession
    checked = staged(D.check_quotes(inputs.extractions, inputs.sections), run, "checked_items")
    ok = checked.where("holds").drop("holds")
    said = ok.select(F.col("industry").alias("name"), "pos").unionByName(
        ok.where(F.coalesce("segment", F.lit("")) != "").select(F.col("segment").alias("name"), "pos"))
    industry = staged(NM.resolve_industries(said, NM.industry_vocabulary(edges, R.map_rows(inputs.maps)),
                                            _pairs(spark, inputs.aliases)), run, "industries")
    items = ok.withColumnRenamed("industry", "name").join(industry.select("name", "industry"), "name")
    folded = staged(D.fold(items), run, "folded_items")
    prefix = inputs.sections.select("ticker", F.concat("report_nm", F.lit("("), "rcept_dt", F.lit("): ")).alias("prefix"))
    return D.filing_edges(folded, industry, asof, prefix), {
        "dropped_quotes": checked.where(~F.col("holds")).drop("holds"), "quote_stats": D.quote_stats(checked),
        "relations_without_products": D.relations_without_products(folded)}


def persistent_tables(inputs: Inputs, master: DataFrame, asof: str, run: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Edges that outlive the day (maps, earlier edges, profiles, filings, contracts, preferred shares),
    and what each step left out, by table name."""
    spark = master.sparkSession
    keep = lambda name, df: staged(df, run, name)
    index = keep("name_index", NM.name_index(master))
    map_names = keep("map_names", NM.resolve(inputs.maps, master, index))
    from_maps = keep("map_edges", R.map_edges(inputs.maps, map_names, asof))
    lists, rejects = [from_maps], {"unresolved_map_names": NM.unresolved(map_names)}

    def add(name: str, rejected: str, both: tuple[DataFrame, DataFrame]) -> None:
        lists.append(keep(name, both[0]))
        rejects[rejected] = both[1]

    if inputs.persistent is not None:
        known, rejects["unknown_relations"] = R.known_relations(inputs.persistent)
        lists.insert(0, R.persistent_only(known))
    if inputs.profiles is not None:
        named = NM.resolve(inputs.profiles, master, index, "other_name")
        add("profile_edges", "unresolved_profiles", R.profile_trades(inputs.profiles, named, master, asof))
    if inputs.extractions is not None:
        edges, left_out = filing_edges(inputs, from_maps, asof, run)
        lists.append(keep("filing_edges", edges))
        rejects |= left_out
        add("trade_edges", "unlisted_counterparties", D.company_trades(
            inputs.extractions, master, index, _pairs(spark, inputs.counterparty_aliases), asof))
    if inputs.contracts is not None:
        parsed = keep("contracts", D.parsed_contracts(D.latest_filings(inputs.contracts)))
        add("contract_edges", "unlisted_buyers", D.contract_edges(parsed, master, index, asof))
    merged = keep("merged_edges", R.merge(*lists))
    inherited, rejects["orphan_preferred"] = R.inherit_preferred(merged, master, asof)
    merged = R.merge(merged, inherited)
    if inputs.profiles is not None:
        products = inputs.profiles.groupBy("ticker").agg(F.min("products").alias("products"))
        merged = R.backfill_products(merged, products)
    return merged, rejects


def build_persistent(inputs: Inputs, master: DataFrame, asof: str) -> DataFrame:
    """The edges of ``persistent_tables`` alone."""
    return persistent_tables(inputs, master, asof, new_run(asof))[0]


def run_daily(inputs: Inputs, as_of: str, settings: Settings | None = None, strict: bool = False) -> Run:
    """One day end to end: screen, groups, factors, gaps, relation graph, price evidence, texts.

    Result names that start with ``rejects_`` hold what a step left out. ``strict`` stops the run when
    there are fewer trading days than the screen looks back. ``discard()`` of the result deletes the
    staged tables once the results are stored.
    """
    cfg = settings or Settings()
    run = new_run(as_of)
    keep = lambda name, df: staged(df, run, name)
    snapshots = gated_snapshots(inputs.snapshots)
    panel = keep("panel", P.price_panel(snapshots, cfg.screen.lookback_days, as_of, strict))
    cal = keep("calendar", panel.select("base_date", "dt_idx", "age", "n_days").distinct())
    newest = snapshots.where(F.col("base_date") <= F.lit(as_of))
    master = keep("master", P.master_from_snapshot(newest))
    sig.require_caps(master)
    top, universe = sig.screen(panel, master, cfg.screen)
    universe = keep("universe", universe)
    top = keep("candidates", top)

    edges, rejects = persistent_tables(inputs, master, as_of, run)
    persistent = keep("persistent", edges)
    rets = keep("returns", sig.with_daily_return(
        panel.join(universe.select("ticker"), "ticker", "left_semi")).select("ticker", "dt_idx", "age", "n_days", "ret"))
    caps = master.select("ticker", "market_cap")
    market = keep("market", M.market_return(rets, caps))

    industry_members = R.members(persistent)
    industry_ret = G.industry_returns(rets, industry_members, caps, cfg.lags.min_members).select(
        F.col("industry").alias("name"), "dt_idx", "ret")
    series = keep("industry_series", L.residualize(industry_ret, market, cal))
    scored = L.score_edges(persistent, series, cfg.lags.max_lag, cfg.lags.min_obs)
    if inputs.cycle_lags is not None:
        scored = L.attach_cycle_lags(scored, inputs.cycle_lags)
    scored = keep("scored_edges", scored)

    member_sets = [G.industry_groups(persistent)]
    if inputs.group_listing is not None:
        member_sets.append(G.group_catalog(inputs.group_listing))
    groups = keep("groups", G.union_groups(*member_sets, universe=universe))
    group_ret = keep("group_returns", G.group_returns(rets, groups))
    gaps = keep("gaps", X.group_gaps(rets, groups, group_ret, X.gap_market(rets, market, cal), cal, cfg.horizontal))
    out = {"panel": panel, "master": master, "candidates": top, "universe": universe, "groups": groups,
           "group_gaps": gaps, "persistent_edges": persistent, "scored_edges": scored,
           "review_queue": L.review_queue(scored, cfg.lags.weak_corr),
           "discoveries": L.discovery_top(L.discover(series, persistent, cfg.lags), cfg.lags.discovery_limit)}

    daily = [R.group_edges(groups, gaps, as_of, cfg.graph)]
    if inputs.factor_specs is not None and inputs.etf_snapshots is not None:
        etf, catalog = P.basket_panel(inputs.etf_snapshots, cal)
        proxies = P.factor_proxies(inputs.factor_specs, catalog, etf)
        closes = etf.join(F.broadcast(proxies.where("not rejected").select("ticker", "factor")), "ticker").select(
            "base_date", "factor", "close")
        f = X.factor_returns(closes, cal)
        window = X.market_window(cal, market, cfg.horizontal.beta_window)
        exp = keep("exposures", X.exposures(rets, f, window, X.market_betas(rets, window), cfg.horizontal))
        out |= {"factor_proxies": proxies, "exposures": exp, "factor_moves": X.factor_moves(f, window)}
        daily.append(R.factor_edges(exp, as_of, cfg.graph))
    graph = keep("graph", R.merge(persistent, R.merge(*daily)))
    asked = top.where(F.col("pos") <= cfg.graph.max_candidates).select("ticker", "pos")
    best = keep("best_gaps", X.best_gap(gaps))
    lines = T.context_lines(graph, keep("asked", asked), master, best, cfg.graph)
    out |= {"graph": graph, "reach": R.reachability(graph, asked, cfg.graph.min_confidence),
            "contexts": keep("contexts", T.context_text(lines))}
    return Run(out | {f"rejects_{name}": table for name, table in rejects.items()}, panel.sparkSession, run)


def run_cycle_lags(inputs: Inputs, as_of: str, settings: Settings | None = None) -> DataFrame:
    """The slow run over the whole market and a long panel; feeds ``Inputs.cycle_lags``."""
    cfg = settings or Settings()
    run = new_run(f"{as_of}-slow")
    keep = lambda name, df: staged(df, run, name)
    snapshots = gated_snapshots(inputs.snapshots)
    panel = keep("panel", P.price_panel(snapshots, None, as_of))
    cal = panel.select("base_date", "dt_idx", "age", "n_days").distinct()
    master = keep("master", P.master_from_snapshot(snapshots.where(F.col("base_date") <= F.lit(as_of))))
    edges = keep("persistent", persistent_tables(inputs, master, as_of, run)[0])
    rets = keep("returns", sig.with_daily_return(panel).select("ticker", "dt_idx", "age", "n_days", "ret"))
    caps = master.select("ticker", "market_cap")
    members = R.members(edges)
    series = L.residualize(G.industry_returns(rets, members, caps, cfg.lags.min_members).select(
        F.col("industry").alias("name"), "dt_idx", "ret"), M.market_return(rets, caps), cal)
    return L.cycle_lags(edges, keep("series", series), members, cfg.lags)


def run_inference(day: dict[str, DataFrame], analyses: DataFrame, syntheses: DataFrame, as_of: str) -> Run:
    """Stored analyses against the tables of ``run_daily``: validated, resolved, priced, traced to the graph.

    analyses(ticker, payload) and syntheses(run, payload) hold JSON; a document with a problem is left
    out whole and its problems are ``rejects_...`` rows, the others stay. ``cases`` are the summaries
    with ticker, gap and provenance filled in, as ``run_scoring`` reads them once they have aged.
    """
    run = new_run(f"{as_of}-inference")
    keep = lambda name, df: staged(df, run, name)
    checked = keep("checked_analyses", V.validate_analyses(analyses))
    summed = keep("checked_syntheses", V.validate_synthesis(syntheses))
    usable, runs = V.usable(checked), V.usable(summed)
    named = keep("beneficiaries", V.analysis_beneficiaries(usable).unionByName(V.synthesis_beneficiaries(runs)))
    master = day["master"]
    resolved = keep("resolved", NM.resolve(named, master, keep("name_index", NM.name_index(master)), "name"))
    best = keep("best_gaps", X.best_gap(day["group_gaps"]))
    reach = keep("reach", R.reach_overall(day["reach"]))
    priced = keep("priced_in", V.annotate_priced_in(named, resolved, sig.compute_signals(day["panel"]), best))
    marked = keep("marked", V.with_provenance(priced, reach))
    return Run({"analyses": usable, "industry_wide": V.industry_wide(usable), "beneficiaries": priced, "provenance": marked,
                "match_stats": V.match_stats(priced), "provenance_stats": V.provenance_stats(marked),
                "cases": keep("cases", V.annotated_cases(runs, resolved, best, reach, as_of)),
                "rejects_analyses": V.problem_rows(checked, "ticker"), "rejects_syntheses": V.problem_rows(summed, "run"),
                "rejects_unmatched_names": V.unmatched_names(priced)}, checked.sparkSession, run)


def run_report(day: dict[str, DataFrame], inference: dict[str, DataFrame], maps: DataFrame, as_of: str,
               settings: Settings | None = None) -> Run:
    """The tables behind the reports: flow graph, layers, chains, trades, coverage, indicators.

    ``day`` and ``inference`` are the results of ``run_daily`` and ``run_inference``, ``maps`` those of
    the daily inputs. Layers and closure read the whole flow but for ``cycle_cuts``.
    """
    cfg = (settings or Settings()).graph
    run = new_run(f"{as_of}-report")
    keep = lambda name, df: staged(df, run, name)
    graph, master = day["graph"], day["master"]
    members = keep("members", R.members(graph))
    flow, origins = keep("flow", Ch.flow_edges(graph)), keep("origins", Ch.relation_origins(graph))
    kept_edges, cuts = Ch.break_cycles(flow)
    kept_edges = keep("acyclic", kept_edges)
    seeds = origins.select("industry").distinct()
    towards = lambda rel: origins.where(F.col("rel") == rel).select(
        F.col("industry").alias("node"), F.col("other").alias("target"), "n_origins")
    map_names = NM.resolve(maps, master, NM.name_index(master))
    ideas = inference["cases"].select(F.explode("synthesis.ideas").alias("i"))
    return Run({
        "kpis": T.kpi_row(day["candidates"], ideas, day["group_gaps"], graph, inference["provenance"]),
        "relation_kpis": T.relation_kpis(graph, origins), "industry_rank": T.industry_rank(graph, origins),
        "top_neighbours": T.top_neighbours(origins), "industry_makes": T.industry_makes(graph),
        "members_by_cap": T.members_by_cap(members, master, ["industry"], cfg.max_members),
        "drivers": T.drivers_by_weight(Cl.driver_shares(graph, cfg.min_confidence), cfg.max_drivers),
        "search_index": T.search_index(graph, origins, master),
        "trades": keep("trades", T.trades_in_order(T.trade_rollup(graph), master)),
        "coverage_holes": T.coverage_holes(R.map_rows(maps), map_names, inference["rejects_unmatched_names"]),
        "flow": flow, "flow_labels": Ch.flow_labels(graph), "orphan_industries": Ch.orphan_industries(members, flow),
        "cycle_cuts": keep("cycle_cuts", cuts), "layers": keep("layers", Ch.layers(kept_edges)),
        "downstream": keep("downstream", Ch.closure(kept_edges)),
        "supply_chains": keep("supply_chains", Ch.chain_levels(seeds, towards(S.REL_UPSTREAM), cfg.chain_caps)),
        "demand_chains": keep("demand_chains", Ch.chain_levels(seeds, towards(S.REL_DOWNSTREAM), cfg.chain_caps)),
    }, graph.sparkSession, run)


def run_scoring(cases: DataFrame, prices: DataFrame, as_of: str, horizon: int = 10) -> Run:
    """Score aged predictions of case files against later prices(ticker, day, close)."""
    predictions = K.aged_predictions(cases, as_of, K.min_age_days(horizon))
    run = new_run(f"{as_of}-scoring")
    scored = staged(K.score_rows(predictions, K.forward_returns(predictions, prices, horizon)), run, "scored")
    return Run({"scored": scored, "summary": K.summary(scored), "directional": K.directional_hit_rate(scored),
                "gap_validity": K.gap_validity(scored)}, scored.sparkSession, run)


STORED = ("candidates", "universe", "groups", "group_gaps", "exposures", "scored_edges", "graph", "contexts")


def save_run(results: dict[str, DataFrame], folder: str, as_of: str) -> None:
    """Store the day's tables under ``folder``, one partition per date; other dates stay."""
    for name in STORED:
        if name in results:
            save_by_date(results[name].withColumn("base_date", F.lit(as_of)), f"{folder}/{name}")
