"""Name expressions. Matching is exact after normalization; similarity only ever suggests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline import settings as S


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold_width(col: Column) -> Column:
    """NFKC. Pure ASCII text is already folded and is handed over as NULL."""
    return F.coalesce(_nfkc(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def normalize_name(col: Column) -> Column:
    """Blanks, company-form marks, case and character width do not distinguish names."""
    return F.upper(F.regexp_replace(fold_width(col), "(?U)" + S.NAME_NOISE, ""))


def explicit_ticker(col: Column) -> Column:
    """The ticker of the form ``name(ticker)``; NULL when the form is not used."""
    t = F.trim(col)
    return F.when(t.rlike(S.EXPLICIT_TICKER), F.regexp_extract(t, S.EXPLICIT_TICKER, 2))


def normalize_industry(col: Column) -> Column:
    """Separators removed, then suffixes peeled one at a time while two characters remain."""
    bare = F.regexp_replace(F.coalesce(col, F.lit("")), "(?U)" + S.INDUSTRY_NOISE, "")

    def peel(s: Column, _: Column) -> Column:
        tail = F.length(F.regexp_extract(s, S.INDUSTRY_SUFFIX, 0))
        keep = F.length(s) - tail
        return F.when((tail > 0) & (keep >= 2), F.left(s, keep)).otherwise(s)

    rounds = F.sequence(F.lit(1), F.greatest(F.length(bare), F.lit(1)))
    return F.upper(F.aggregate(rounds, bare, peel))


def is_preferred(name: Column) -> Column:
    return F.coalesce(name.rlike(S.PREFERRED_NAME), F.lit(False))


def has_no_value_chain(name: Column) -> Column:
    return F.coalesce(name.rlike(S.NO_VALUE_CHAIN_NAME), F.lit(False))
