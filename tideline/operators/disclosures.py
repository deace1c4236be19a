"""Jobs over filings: quote checks, folding of extracted items, and edges from disclosures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import documents as D
from tideline.functions import nodes as N
from tideline.functions.contracts import contract_party, parse_contract
from tideline.functions.names import has_no_value_chain, is_preferred
from tideline.operators import graph as R
from tideline.operators import names as NM

SIDES = ("products", "upstream", "downstream")


def check_quotes(items: DataFrame, documents: DataFrame) -> DataFrame:
    """items(ticker, side, pos, quote, ...) plus ``holds``: the quote is in the ticker's own text.

    Texts are squashed once per document, then met by equality on the ticker.
    """
    docs = documents.select("ticker", D.squash(F.col("text")).alias("_source"))
    j = items.withColumn("_quote", D.squash(F.col("quote"))).join(docs, "ticker", "left")
    ok = F.coalesce(D.quote_holds(F.col("_quote"), F.col("_source")), F.lit(False))
    return j.withColumn("holds", ok).drop("_quote", "_source")


def quote_stats(checked: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Kept and dropped quotes, the drop rate, and whether it deserves an alert."""
    agg = checked.groupBy(*keys).agg(F.count_if("holds").alias("kept"),
                                     F.count_if(~F.col("holds")).alias("dropped"))
    rate = F.col("dropped") / (F.col("kept") + F.col("dropped"))
    return agg.withColumn("drop_rate", rate).withColumn("alert", rate > S.DROP_RATE_ALERT)


def dropped_samples(checked: DataFrame, per_ticker: int = 5) -> DataFrame:
    """Up to five dropped quotes per ticker, in order (a report limit)."""
    order = F.when(F.col("side") == "products", 0).when(F.col("side") == "upstream", 1).otherwise(2)
    w = Window.partitionBy("ticker").orderBy(order, "pos")
    text = F.concat("side", F.lit(":"), "industry", F.lit(" — "), "quote")
    return checked.where(~F.col("holds")).withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= per_ticker).select("ticker", "rank", text.alias("sample"))


def tier_confidence(tier):
    out = F.lit(S.DEFAULT_TIER_CONFIDENCE)
    for t, conf in S.TIER_CONFIDENCE.items():
        out = F.when(tier == t, conf).otherwise(out)
    return out


def fold(items: DataFrame) -> DataFrame:
    """One row per (ticker, side, industry): shares add up, the strongest tier speaks.

    items(ticker, side, pos, industry, share, tier, what, segment, quote) with resolved industries.
    Distinct products keep their order; the lists are as long as one filing's items.
    """
    i = items.where(F.coalesce("industry", F.lit("")) != "").withColumn(
        "conf", tier_confidence(F.col("tier")))
    best = F.struct((-F.col("conf")).alias("k"), "pos")
    what = F.filter(F.array_distinct(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", F.trim(F.coalesce("what", F.lit(""))).alias("w")))),
        lambda x: x["w"])), lambda w: w != "")
    segs = F.filter(F.collect_set(F.trim(F.coalesce("segment", F.lit("")))), lambda s: s != "")
    return i.groupBy("ticker", "side", "industry").agg(
        F.sum("share").alias("share"), F.max("conf").alias("confidence"),
        F.min_by("quote", best).alias("quote"), F.min("pos").alias("pos"),
        what.alias("products"), segs.alias("segments"))


def anchor_industry(folded: DataFrame) -> DataFrame:
    """(ticker, primary, n_products): the product industry with the largest share, else the first."""
    p = folded.where(F.col("side") == "products")
    rank = F.struct(F.col("share").isNull().alias("none"), (-F.coalesce("share", F.lit(0.0))).alias("k"),
                    "pos")
    return p.groupBy("ticker").agg(F.min_by("industry", rank).alias("primary"),
                                   F.count("*").alias("n_products"))


def filing_edges(folded: DataFrame, segments: DataFrame, asof: str,
                 prefix: DataFrame | None = None) -> DataFrame:
    """Membership and industry relations of each filing.

    A relation starts at the one product industry its segment names, else at the anchor, marked as
    a guess when the filer has several. ``segments(name, industry)`` resolves segment names;
    ``prefix(ticker, prefix)`` opens the evidence text.
    """
    f = folded if prefix is None else folded.join(prefix, "ticker", "left")
    lead = F.coalesce("prefix", F.lit("")) if prefix is not None else F.lit("")
    ev = F.concat(lead, "quote")
    label = F.array_join("products", " / ")
    prods = f.where(F.col("side") == "products")
    member = R.edges(prods, src=N.ticker_node(F.col("ticker")), dst=N.industry_node(F.col("industry")),
                     rel=S.REL_MEMBER, source="dart", weight=F.col("share"), origin=F.col("ticker"),
                     confidence=F.col("confidence"), product=label, evidence=ev, asof=asof)
    rel = f.where(F.col("side") != "products").join(anchor_industry(folded), "ticker")
    named = rel.select("ticker", "side", "industry", F.explode("segments").alias("name")).join(
        segments.select("name", F.col("industry").alias("seg_industry")), "name").join(
        prods.select("ticker", F.col("industry").alias("seg_industry")), ["ticker", "seg_industry"],
        "left_semi").groupBy("ticker", "side", "industry").agg(
            F.count("*").alias("n_seg"), F.min("seg_industry").alias("seg"))
    j = rel.join(named, ["ticker", "side", "industry"], "left")
    sure = F.col("n_seg") == 1
    j = j.withColumn("anchor", F.when(sure, F.col("seg")).otherwise(F.col("primary"))).withColumn(
        "attribution", F.when(sure, S.ATTRIBUTION_CONFIRMED).when(
            F.col("n_products") > 1, S.ATTRIBUTION_GUESSED).otherwise("")).where(
        F.col("anchor") != F.col("industry"))
    way = F.when(F.col("side") == "upstream", S.REL_UPSTREAM).otherwise(S.REL_DOWNSTREAM)
    common = dict(source="dart", origin=F.col("ticker"), product=label, evidence=ev, asof=asof,
                  attribution=F.col("attribution"), confidence=F.col("confidence"))
    weight = F.when(F.col("side") == "upstream", F.col("share"))
    seq = lambda dir_: F.concat_ws("|", F.when(F.col("side") == "upstream", "0").otherwise("1"),
                                   F.lpad(F.col("pos").cast("string"), 8, "0"), F.lit(dir_))
    fwd = R.edges(j, src=N.industry_node(F.col("anchor")), dst=N.industry_node(F.col("industry")),
                  rel=way, weight=weight, pos=seq("0"), **common)
    back = R.edges(j, src=N.industry_node(F.col("industry")), dst=N.industry_node(F.col("anchor")),
                   rel=R.opposite(way), pos=seq("1"), **common)
    return member.unionByName(fwd).unionByName(back)


def relations_without_products(folded: DataFrame) -> DataFrame:
    """Filings whose relations cannot be attached because they state no product."""
    return folded.groupBy("ticker").agg(
        F.count_if(F.col("side") != "products").alias("n_relations"),
        F.count_if(F.col("side") == "products").alias("n_products")).where(
        (F.col("n_products") == 0) & (F.col("n_relations") > 0)).select("ticker", "n_relations")


# ---- companies named in filings -----------------------------------------------------------

def counterparty_tokens(texts: DataFrame) -> DataFrame:
    """(text, tok_pos, token): the names that a customer or material text lists."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?U)\d+(\.\d+)?\s*%", " "),
                            S.COUNTERPARTY_GENERIC, " ")
    quotes = "".join("\\" + c if c in "\\]^-" else c for c in S.COUNTERPARTY_QUOTES)
    toks = F.filter(F.transform(F.split(bare, "(?U)" + S.COUNTERPARTY_SPLIT), lambda t: F.regexp_replace(
        t, rf"\A[{quotes}]+|[{quotes}]+\z", "")), lambda t: t != "")
    return texts.select("text", F.posexplode(toks).alias("tok_pos", "token"))


def company_trades(items: DataFrame, master: DataFrame, index: DataFrame, aliases: DataFrame, asof: str,
                   cfg: S.GraphSettings = R.CFG) -> tuple[DataFrame, DataFrame]:
    """(edges along the flow of goods, names that are not listed companies).

    Many items share a text: each distinct text is taken apart and looked up once, then met by equality.
    """
    rows = items.where(F.col("side").isin("upstream", "downstream")).select(
        "ticker", "side", "pos", F.coalesce("what", F.lit("")).alias("text"), "quote")
    t = counterparty_tokens(rows.select("text").distinct()).join(
        aliases.select(F.col("alias").alias("token"), "target"), "token", "left")
    t = t.where((F.length("token") >= S.MIN_COUNTERPARTY_CHARS) | F.col("target").isNotNull())
    t = t.withColumn("company", F.coalesce("target", "token"))
    res = NM.resolve(t, master, index).withColumnRenamed("ticker", "other")
    t = t.join(res, "company", "left")
    names = t.where(F.col("other").isNull() & F.col("token").rlike("[가-힣A-Za-z]{3,}")).select("text", "token").distinct()
    unlisted = rows.select("ticker", "text").join(names, "text").select("ticker", "token").distinct()
    # a company found twice in one text keeps its first spelling
    told = t.where(F.col("other").isNotNull()).groupBy("text", "other").agg(F.min_by("token", "tok_pos").alias("token"))
    after = r"(?U)\s*[(（]?\s*(\d+(?:\.\d+)?)\s*%"
    share = F.call_function("regexp_extract", F.col("text"), F.concat(
        D.regex_literal(F.col("token")), F.lit(after)), F.lit(1)).try_cast("double")
    first = rows.join(told.select("text", "other", share.alias("share")), "text").where(F.col("other") != F.col("ticker"))
    fwd = F.col("side") == "downstream"
    out = R.edges(first, src=N.ticker_node(F.when(fwd, F.col("ticker")).otherwise(F.col("other"))),
                  dst=N.ticker_node(F.when(fwd, F.col("other")).otherwise(F.col("ticker"))),
                  rel=S.REL_DOWNSTREAM, source="dart", origin=F.col("ticker"), asof=asof,
                  weight=F.col("share") / 100, product=F.col("text"), confidence=cfg.trade_confidence,
                  evidence=F.coalesce("quote", F.lit("")),
                  pos=F.concat_ws("|", F.when(fwd, F.lit("0")).otherwise(F.lit("1")),
                                  F.lpad(F.col("pos").cast("string"), 8, "0")))
    return out, unlisted


# ---- contracts ----------------------------------------------------------------------------

def latest_filings(filings: DataFrame) -> DataFrame:
    """One row per receipt number; a row filed later replaces an earlier one."""
    rest = [c for c in filings.columns if c != "rcept_no"]
    last = F.max_by(F.struct(*rest), F.struct("rcept_dt", *[c for c in rest if c != "rcept_dt"]))
    return filings.groupBy("rcept_no").agg(last.alias("r")).select(
        "rcept_no", *[F.col(f"r.{c}").alias(c) for c in rest])


def parsed_contracts(filings: DataFrame) -> DataFrame:
    return filings.withColumn("parsed", parse_contract(F.col("text"))).drop("text")


def contract_parties(filings: DataFrame) -> DataFrame:
    """The filings with the buyer they name, which takes a small part of reading a form."""
    return filings.withColumn("company", contract_party(F.col("text"))).drop("text")


def contract_coverage(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("n_parsed"),
                      F.count_if(F.col("parsed.counterparty") != "").alias("n_named"),
                      F.count_if(F.col("parsed.amount").isNotNull()).alias("n_amounts"))


def _met_parties(parties: DataFrame, master: DataFrame, index: DataFrame) -> DataFrame:
    """Filings of listed sellers that name a buyer, with the buyer's ticker if it is listed."""
    listed = parties.withColumn("seller", F.trim(F.coalesce("stock_code", F.lit("")))).join(
        master.select(F.col("ticker").alias("seller")), "seller", "left_semi")
    named = listed.where(F.col("company") != "")
    return named.join(NM.resolve(named, master, index).withColumnRenamed("ticker", "buyer"), "company", "left")


def _between_listed(met: DataFrame) -> DataFrame:
    return met.where(F.col("buyer").isNotNull() & (F.col("buyer") != F.col("seller")))


def unlisted_buyers(parties: DataFrame, master: DataFrame, index: DataFrame) -> DataFrame:
    """(company, corp_name): buyers that are not listed, with their newest seller; ``parties`` as of ``contract_parties``."""
    return _met_parties(parties, master, index).where(F.col("buyer").isNull()).groupBy("company").agg(
        F.max_by("corp_name", F.struct("rcept_dt", "rcept_no")).alias("corp_name"))


def _contract_pos() -> Column:
    return F.concat_ws("|", "rcept_dt", "rcept_no")


def newest_contracts(parties: DataFrame, master: DataFrame, index: DataFrame) -> DataFrame:
    """(rcept_no) of the newest filing of every seller with every listed buyer: the one a merge of edges keeps."""
    good = _between_listed(_met_parties(parties, master, index))
    return good.groupBy("seller", "buyer").agg(F.max(F.struct(_contract_pos().alias("pos"), "rcept_no")).alias("r")).select("r.rcept_no")


def contract_edges(parsed: DataFrame, master: DataFrame, index: DataFrame, asof: str,
                   cfg: S.GraphSettings = R.CFG, limits: S.ContractSettings = S.ContractSettings()
                   ) -> tuple[DataFrame, DataFrame]:
    """(seller -> buyer edges weighted by share of sales, buyers that are not listed).

    ``parsed(rcept_no, report_nm, rcept_dt, corp_name, stock_code, parsed)``; only listed filers.
    """
    parties = parsed.withColumn("company", F.col("parsed.counterparty"))
    unlisted = unlisted_buyers(parties, master, index)
    good = _between_listed(_met_parties(parties, master, index))
    p = lambda f: F.col(f"parsed.{f}")
    own = F.when((p("amount") != 0) & (p("recent_sales") >= limits.min_plausible_sales),
                 F.round(p("amount") / p("recent_sales"), 4))
    ratio = F.coalesce(p("sales_ratio"), own)
    ratio = F.when(ratio <= limits.max_ratio_pct / 100, ratio)
    head = F.concat("report_nm", F.lit("("), "rcept_dt", F.lit(")"))
    money = F.format_number(F.floor(p("amount")), 0)
    ev = F.when(p("amount") != 0, F.concat(head, F.lit(" "), p("begin"), F.lit("~"), p("end"), F.lit(" "),
                                           money, F.lit("원"))).otherwise(head)
    out = R.edges(good, src=N.ticker_node(F.col("seller")), dst=N.ticker_node(F.col("buyer")),
                  rel=S.REL_DOWNSTREAM, source="contract", origin=F.col("seller"), asof=asof,
                  weight=ratio, product=p("product"), confidence=cfg.contract_confidence,
                  evidence=ev, pos=_contract_pos())
    return out, unlisted


# ---- sections of reports ------------------------------------------------------------------

def report_sections(reports: DataFrame) -> DataFrame:
    """Per company: the first of its best reports that has a business chapter, slimmed.

    Annual before half-year before quarterly, newest first; every report of these kinds is tried.
    """
    kind = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(S.REPORT_PRIORITY))):
        kind = F.when(F.contains("report_nm", F.lit(name)), i).otherwise(kind)
    w = Window.partitionBy("corp_code").orderBy("kind", F.col("rcept_dt").desc(), "rcept_no")
    ranked = reports.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn(
        "rank", F.row_number().over(w))
    read = ranked.withColumn("section", D.business_section(F.col("text"))).where(F.col("section") != "")
    first = read.groupBy("corp_code").agg(F.min_by(F.struct(
        "rcept_no", "report_nm", "rcept_dt", "rank", "section"), "rank").alias("r"))
    return first.select("corp_code", "r.*").withColumn("slim", D.slim_section(F.col("section"))).select(
        "corp_code", "rcept_no", "report_nm", "rcept_dt", "rank",
        F.length("section").alias("full_chars"), F.length("slim.text").alias("kept_chars"),
        F.col("slim.text").alias("section"), F.col("slim.titles").alias("kept_sections"))


def mark_long(sections: DataFrame, max_chars: int = 60000) -> DataFrame:
    """Sections whole, with ``is_long`` for those a reader with a limit of ``max_chars`` can't take at once."""
    return sections.withColumn("is_long", F.length("section") > max_chars)


def extraction_volume(sections: DataFrame) -> DataFrame:
    """How much text the slimming left, and how many filings it could not slim."""
    return sections.agg(
        F.count("*").alias("n_docs"), F.sum("full_chars").alias("full_chars"),
        F.sum("kept_chars").alias("kept_chars"),
        F.count_if(F.size("kept_sections") == 0).alias("n_unslimmed")).withColumn(
        "kept_ratio", F.col("kept_chars") / F.greatest(F.lit(1), F.col("full_chars")))


# ---- what to read next --------------------------------------------------------------------

def _todo(universe: DataFrame, mapped: DataFrame, fetched: DataFrame) -> DataFrame:
    flag = lambda d, n: d.select("ticker").distinct().withColumn(n, F.lit(True))
    j = universe.join(flag(mapped, "is_mapped"), "ticker", "left").join(
        flag(fetched, "is_fetched"), "ticker", "left")
    pref = is_preferred(F.col("name"))
    state = (F.when(F.col("is_mapped"), "mapped").when(F.col("is_fetched"), "pending")
             .when(pref, "preferred").when(has_no_value_chain(F.col("name")), "no_chain")
             .otherwise("todo"))
    return j.withColumn("state", state).drop("is_mapped", "is_fetched")


def coverage_targets(universe: DataFrame, mapped: DataFrame, fetched: DataFrame, past: DataFrame,
                     top_n: int) -> DataFrame:
    """Screened tickers that still need a filing: past candidates first, then by cap."""
    todo = _todo(universe, mapped, fetched).where("state = 'todo'").join(
        past.select("ticker").distinct().withColumn("was", F.lit(True)), "ticker", "left")
    return todo.select("ticker", "name", "market_cap", F.coalesce("was", F.lit(False)).alias("past")
                       ).orderBy(F.col("past").desc(), F.col("market_cap").desc(), "ticker").limit(top_n)


def coverage_counts(universe: DataFrame, mapped: DataFrame, fetched: DataFrame) -> DataFrame:
    return _todo(universe, mapped, fetched).groupBy("state").agg(F.count("*").alias("n"))


def past_candidates(*files: DataFrame) -> DataFrame:
    """Distinct tickers over all past candidate lists and cases."""
    rows = [f.select("ticker") for f in files]
    return reduce(DataFrame.unionByName, rows).where(F.coalesce("ticker", F.lit("")) != "").distinct()


def latest_extractions(rows: DataFrame) -> DataFrame:
    """rows(file, ticker, payload): for a ticker the last file by name replaces all earlier ones.

    Within a file the greatest payload by letter stands, so that reruns agree.
    """
    last = rows.groupBy("ticker").agg(F.max(F.struct("file", "payload")).alias("r"))
    return last.select("ticker", "r.payload", "r.file")
