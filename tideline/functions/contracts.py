"""Fields of a supply-contract form, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions.documents import bind, strip_ws

_NUMBER = r"[\d,]{4,}"


def first_amount(col: Column) -> Column:
    """First number of four or more characters that is not a year; NULL when there is none."""
    tokens = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(_NUMBER), F.lit(0))
    values = F.transform(tokens, lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    usable = F.filter(values, lambda v: v.isNotNull() & ~v.between(1900, 2100))
    return F.get(usable, F.lit(0))


def first_date(col: Column) -> Column:
    """First date as YYYYMMDD, '' when there is none."""
    pattern = "(?U)" + S.CONTRACT_DATE

    def read(s: Column) -> Column:
        written = bind(F.regexp_extract(s, pattern, 0), lambda m: F.when(m != "", F.concat(
            F.regexp_extract(m, pattern, 1), F.lpad(F.regexp_extract(m, pattern, 2), 2, "0"),
            F.lpad(F.regexp_extract(m, pattern, 3), 2, "0"))))
        return F.coalesce(written, F.regexp_extract(s, r"(?U)\b(\d{8})\b", 1))

    return bind(F.coalesce(col, F.lit("")), read)


def sales_ratio(col: Column, cfg: S.ContractSettings = S.ContractSettings()) -> Column:
    """Share of sales: ``n%``, ``(%) n`` or a bare ``n``; implausible values are NULL."""
    forms = (r"(?U)([\d.]+)\s*%", r"(?U)\(\s*%\s*\)\s*([\d.]+)", r"(?U)([\d.]+)")
    hit = F.coalesce(*[F.nullif(F.regexp_extract(col, f, 1), F.lit("")) for f in forms])
    return bind(hit.try_cast("double"), lambda pct: F.when(
        (pct > 0) & (pct <= cfg.max_ratio_pct), F.round(pct / 100, 4)))


def clean_value(col: Column) -> Column:
    """First line of a value, cut where another field, a footnote or an open bracket begins."""
    line = F.get(F.split(F.coalesce(col, F.lit("")), "\n"), F.lit(0))
    cuts = [*S.CONTRACT_FIELDS.values(), S.CONTRACT_FOOTNOTE]
    any_cut = "(?U)" + "|".join(f"(?:{p})" for p in cuts)
    # most lines hold nothing to cut: one search tells
    cut = bind(line, lambda s: F.when(s.rlike(any_cut), reduce(
        lambda t, p: F.regexp_replace(t, f"(?sU)(?:{p}).*", ""), cuts, s)).otherwise(s))
    closed = bind(cut, lambda c: F.when(
        F.regexp_count(c, F.lit(r"\(")) > F.regexp_count(c, F.lit(r"\)")),
        F.regexp_extract(c, r"(?s)\A(.*)\(", 1)).otherwise(c))
    return F.regexp_replace(closed, "(?U)" + S.CONTRACT_EDGE_NOISE, "")


def plausible_name(col: Column) -> Column:
    s = strip_ws(F.coalesce(col, F.lit("")))
    return (F.length(s) >= 2) & ~s.rlike("(?U)" + S.CONTRACT_BOILERPLATE) & s.rlike("[가-힣A-Za-z]{2,}")


def _flat(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\u00a0]{2,}|[\t\u00a0]", " ")


def _raw(flat: Column, field: str) -> Column:
    return strip_ws(F.regexp_extract(flat, rf"(?sU){S.CONTRACT_FIELDS[field]}\s*[:：]?\s*(.{{0,200}})", 1))


def _party(raw: Column) -> Column:
    return bind(clean_value(raw), lambda p: F.when(plausible_name(p), p).otherwise(F.lit("")))


def contract_party(text: Column) -> Column:
    """The counterparty alone, as ``parse_contract`` reads it."""
    return _party(_raw(_flat(text), "counterparty"))


def parse_contract(text: Column) -> Column:
    """STRUCT of typed contract fields; what cannot be read is NULL or ''."""
    def raw_fields(flat: Column) -> Column:
        return F.struct(*[_raw(flat, k).alias(k) for k in S.CONTRACT_FIELDS])

    def or_else(first: Column, other: Column) -> Column:
        return bind(first, lambda d: F.when(d != "", d).otherwise(other))

    def typed(raw: Column) -> Column:
        spans = F.regexp_extract_all(raw["period"], F.lit("(?U)" + S.CONTRACT_DATE), F.lit(0))
        return F.struct(
            _party(raw["counterparty"]).alias("counterparty"),
            clean_value(raw["product"]).alias("product"),
            first_amount(raw["amount"]).alias("amount"),
            first_amount(raw["recent_sales"]).alias("recent_sales"),
            sales_ratio(raw["ratio"]).alias("sales_ratio"),
            or_else(first_date(raw["begin"]), first_date(raw["period"])).alias("begin"),
            or_else(first_date(raw["end"]), F.coalesce(first_date(F.get(spans, F.lit(1))), F.lit(""))).alias("end"),
            clean_value(raw["region"]).alias("region"))

    return bind(bind(_flat(text), raw_fields), typed)


def is_contract_filing(report_name: Column) -> Column:
    return F.coalesce(report_name.rlike("|".join(S.CONTRACT_FILING_NAMES)), F.lit(False))
