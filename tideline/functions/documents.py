"""Text of filings and pages: markup, sections, quotes, digests.

Everything is a Column expression over whole texts, except the decoding of character references,
which is a one-line Arrow function and only sees texts that contain an ampersand.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline import settings as S

_WS = r"(?U)\s+"
#: All that ``\s`` means with (?U): the characters with the property White_Space.
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(col: Column) -> Column:
    """Leading and trailing white space of any kind removed; only the ends of a text are looked at."""
    return F.btrim(col, F.lit(_BLANKS))


@F.pandas_udf(T.StringType())
def _decode_references(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def decode_references(col: Column) -> Column:
    return F.coalesce(_decode_references(F.when(F.contains(col, F.lit("&")), col)), col)


def strip_tags(col: Column) -> Column:
    """Tags out, the two entities news feeds use decoded, trimmed."""
    bare = F.regexp_replace(col, "<[^>]+>", "")
    return strip_ws(F.replace(F.replace(bare, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))


def markup_to_text(col: Column) -> Column:
    """Markup as lines of text in which table cells stay apart."""
    t = F.regexp_replace(col, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</(?:TR|TABLE|P|TITLE|SECTION-\d)\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)<BR\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(?:TD|TE|TH)\s*>", " | ")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.replace(decode_references(t), F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: strip_ws(F.regexp_replace(x, r"\A[ |]+|[ |]+\z", "")))
    return strip_ws(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


# ---- sections -----------------------------------------------------------------------------

def bind(value: Column, body) -> Column:
    """body(value) with ``value`` computed once: inside a lambda, outer expressions are not shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def business_section(text: Column) -> Column:
    """The business chapter of a filing, '' when there is none.

    The text is cut before every chapter heading. A heading with a long tail on its line is a cross
    reference, not a heading. The chapter runs to the heading of the next chapter; the longest one
    that has such an end wins, else the longest that runs to the end of the text.
    """
    starts_here = rf"(?Ud)\A{S.SECTION_START}"
    tail_at = rf"(?Ud)\A{S.SECTION_START}([^\n]*)"

    def chapter(pieces: Column, i: Column) -> Column:
        piece = F.get(pieces, i)
        heading = piece.rlike(starts_here) & (
            F.length(strip_ws(F.regexp_extract(piece, tail_at, 1))) <= S.MAX_HEADING_TAIL)
        body = F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "")
        found = bind(F.split(body, f"(?Ud){S.SECTION_END}", 2), lambda cut: bind(
            strip_ws(F.get(cut, F.lit(0))), lambda section: F.struct(
                (F.size(cut) == 2).alias("bounded"), F.length(section).alias("len"),
                (-i).alias("first"), section.alias("section"))))
        return F.when(heading, found)

    def longest(pieces: Column) -> Column:
        chapters = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1),
                                               lambda i: chapter(pieces, i)))
        return F.array_max(F.filter(chapters, lambda c: c["len"] > 0))

    best = bind(F.split(text, f"(?Ud)(?={S.SECTION_START})"), longest)
    return bind(best, lambda b: F.when(b["len"] >= S.MIN_SECTION_CHARS, b["section"]).otherwise(F.lit("")))


#: A control character that markup can't hold; it marks where a text is cut.
CUT = "\u0001"


def subsections(section: Column) -> Column:
    """ARRAY<STRUCT<title, body>>: the text cut before every numbered sub-heading.

    A number alone on its line takes the next line as its title, even one with a number of its own:
    headings are marked from left to right without overlap, then the text is cut at the marks.
    """
    inner = S.SUBSECTION_LINE[1:]
    pieces = F.split(F.regexp_replace(section, f"(?Umd)^{inner}", CUT + "$0"), CUT)
    titled = F.transform(pieces, lambda p: F.struct(
        strip_ws(F.regexp_extract(p, rf"(?Umd)\A{inner}", 1)).alias("title"), p.alias("body")))
    return F.filter(titled, lambda p: p["title"] != "")


def slim_section(section: Column) -> Column:
    """STRUCT<text, titles>: only the sub-sections about products, materials, sales and orders.

    The section stays whole when it has too few sub-headings or too little would be left.
    """
    def slim(subs: Column) -> Column:
        kept = F.filter(subs, lambda p: p["title"].rlike("(?U)" + S.SUBSECTION_KEEP))
        return F.struct(
            F.when(F.size(subs) >= S.MIN_SUBSECTIONS, strip_ws(F.array_join(
                F.transform(kept, lambda p: p["body"]), "\n"))).alias("text"),
            F.transform(kept, lambda p: p["title"]).alias("titles"))

    none = F.array().cast("array<string>")
    return bind(bind(subsections(section), slim), lambda s: F.when(
        F.length(s["text"]) >= S.MIN_KEPT_CHARS, s).otherwise(
            F.struct(section.alias("text"), none.alias("titles"))))


def best_window(text: Column, budget: int) -> Column:
    """The stretch of ``budget`` characters that says most about what the company sells.

    Product cues count 1, references to the company itself 0.5, and the distance from the start of
    the text up to -3; the earliest of equals wins. ``text`` must be a bound value.
    """
    step = max(1, budget // 4)

    def window(start: Column) -> Column:
        span = F.greatest(F.lit(1), F.length(text) - budget)
        return bind(F.substring(text, start + 1, F.lit(budget)), lambda w: F.struct(
            (F.regexp_count(w, F.lit("(?U)" + S.PRODUCT_CUE)) + 0.5 * F.regexp_count(
                w, F.lit(S.SELF_REFERENCE)) - 3.0 * (start / span)).alias("score"),
            (-start).alias("first"), w.alias("w")))

    last = F.length(text) - budget + step - 1
    best = F.array_max(F.transform(F.sequence(F.lit(0), last, F.lit(step)), window))
    return F.when(F.length(text) <= budget, text).otherwise(best["w"])


def membership_digest(section: Column, budget: int = S.DIGEST_BUDGET) -> Column:
    """Short text about what the company sells, enough to place it in an industry."""
    def digest(subs: Column) -> Column:
        keep = F.filter(subs, lambda p: p["title"].rlike("(?U)" + S.DIGEST_KEEP)
                        & ~p["title"].rlike("(?U)" + S.DIGEST_DROP))
        bodies = F.transform(keep, lambda p: strip_ws(p["body"]))
        parts = F.transform(bodies, lambda t: best_window(t, S.DIGEST_BLOCK_BUDGET))
        joined = bind(strip_ws(F.array_join(parts, "\n\n")),
                      lambda t: F.when(t != "", t).otherwise(section))
        return F.when(F.size(subs) < 2, F.left(section, F.lit(budget))).otherwise(
            bind(joined, lambda t: best_window(t, budget)))

    return bind(subsections(section), digest)


# ---- quotes -------------------------------------------------------------------------------

def squash(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), _WS, "")


def quote_holds(squashed_quote: Column, squashed_source: Column) -> Column:
    """The quote is long enough to mean something and occurs in the source, blanks aside."""
    floor = F.when(squashed_quote.rlike(r"\p{Nd}"), S.MIN_NUMERIC_QUOTE_CHARS).otherwise(S.MIN_QUOTE_CHARS)
    return (F.length(squashed_quote) >= floor) & F.contains(squashed_source, squashed_quote)


# ---- news ---------------------------------------------------------------------------------

def regex_literal(col: Column) -> Column:
    return F.regexp_replace(col, r"([\\.\[\]{}()*+?^$|\-&])", r"\\$1")


def mentions_company(name: Column, text: Column) -> Column:
    """The name occurs and ends there: no other Hangul follows it except a particle."""
    after = rf"(?:\z|[^가-힣]|(?:{'|'.join(S.PARTICLES)}))"
    return (name != "") & F.rlike(text, F.concat(regex_literal(name), F.lit(after)))


def market_relevant(name: Column, title: Column, description: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    return F.coalesce(mentions_company(name, text) & text.rlike(S.MARKET_KEYWORDS), F.lit(False))
