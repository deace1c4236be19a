"""Price snapshots and panels.

A panel is a *sparse* long table: one row per (day, ticker) that traded. Missing means NULL.
Every row carries the position of its day in the trading calendar:

    dt_idx   0 for the oldest day
    age      0 for the newest day
    n_days   length of the calendar

All offsets are calendar offsets (``age``/``dt_idx`` ranges), never row offsets, so halted days
stay visible without building a dense day x ticker grid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions.numbers import numeric_text


class SourceError(ValueError):
    """An input does not have the shape the job needs."""


def resolve_fields(df: DataFrame, candidates: Mapping[str, Sequence[str]],
                   optional: Sequence[str] = ()) -> DataFrame:
    """Rename the first present candidate column to its canonical name.

    A missing required field is an error that lists the columns that do exist.
    """
    chosen, missing = [], []
    for canonical, names in candidates.items():
        actual = next((n for n in names if n in df.columns), None)
        if actual is not None:
            chosen.append(F.col(f"`{actual}`").alias(canonical))
        elif canonical not in optional:
            missing.append(canonical)
    if missing:
        raise SourceError(f"no column for {missing}; columns present: {sorted(df.columns)}")
    return df.select(*chosen)


def cast_numeric(df: DataFrame, text_fields: Sequence[str]) -> DataFrame:
    """Every column except the text fields becomes DOUBLE, bad values NULL."""
    return df.select(*[F.col(c) if c in text_fields else numeric_text(F.col(c)).alias(c)
                       for c in df.columns])


def clean_code(raw: Column) -> Column:
    return F.upper(F.trim(raw.cast("string")))


def pad_code(code: Column) -> Column:
    """Left-pad to six characters; longer codes stay whole."""
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def normalize_ticker(raw: Column) -> Column:
    s = clean_code(raw)
    return (F.when(s.rlike(S.STANDARD_CODE), F.regexp_extract(s, S.STANDARD_CODE, 1))
            .otherwise(pad_code(s)))


def looks_like_code(raw: Column) -> Column:
    """Shape test on the raw value, before any padding could disguise it."""
    s = clean_code(raw)
    digits = s.rlike(r"^\d+$")
    padded = F.when(digits, pad_code(s)).otherwise(s)
    return s.rlike(S.STANDARD_CODE) | padded.rlike(S.SHORT_CODE)


def code_quality(df: DataFrame, raw: str, max_odd: float = 0.05) -> DataFrame:
    """One row: how many codes have an unexpected shape, and whether the load must stop."""
    odd = ~looks_like_code(F.col(raw))
    agg = df.agg(F.count("*").alias("n_rows"), F.count_if(odd).alias("n_odd"))
    return agg.withColumn("failed", F.col("n_odd") > F.col("n_rows") * max_odd)


def gate_codes(df: DataFrame, raw: str, max_odd: float = 0.05) -> DataFrame:
    """Normalized tickers, or an error when more than ``max_odd`` of the codes look wrong."""
    q = code_quality(df, raw, max_odd).first()
    if q["failed"]:
        raise SourceError(f"{q['n_odd']} of {q['n_rows']} codes have an unexpected shape")
    return df.withColumn("ticker", normalize_ticker(F.col(raw)))


def first_per_ticker(df: DataFrame, position: list[str]) -> DataFrame:
    """Full-market snapshot: the first row of a (day, ticker) wins.

    ``min_by`` combines map-side, so a day or ticker that holds most rows costs one row per task.
    """
    keys = ["base_date", "ticker"]
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*position)).alias("r")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def calendar(days: DataFrame, n_days: int | None = None, end_date=None) -> DataFrame:
    """Trading calendar out of the days that have rows: the last ``n_days`` up to ``end_date``.

    One row per day, so the unpartitioned window below sorts a table bounded by calendar length.
    """
    d = days.select("base_date").distinct()
    if end_date is not None:
        d = d.where(F.col("base_date") <= F.lit(end_date))
    newest = Window.orderBy(F.col("base_date").desc())
    d = d.withColumn("age", F.row_number().over(newest) - 1)
    if n_days is not None:
        d = d.where(F.col("age") < n_days)
    d = d.withColumn("n_days", F.count("*").over(Window.partitionBy(F.lit(0))).cast("int"))
    return d.select("base_date", (F.col("n_days") - 1 - F.col("age")).cast("int").alias("dt_idx"),
                    F.col("age").cast("int").alias("age"), "n_days")


def price_panel(snapshots: DataFrame, n_days: int | None = None, end_date=None,
                strict: bool = False) -> DataFrame:
    """Sparse panel over the last ``n_days`` trading days; non-positive closes are dropped.

    With ``strict`` the job fails when fewer than ``n_days`` trading days exist.
    """
    cal = calendar(snapshots, n_days, end_date)
    if strict and n_days is not None:
        cal = cal.withColumn("n_days", F.when(F.col("n_days") < n_days, F.raise_error(
            F.concat(F.lit(f"asked for {n_days} trading days, found "),
                     F.col("n_days").cast("string"))).cast("int")).otherwise(F.col("n_days")))
    live = snapshots.where(F.col("close") > 0)
    # one row per calendar day: bounded, safe to broadcast
    return live.join(F.broadcast(cal), "base_date")


def basket_panel(etf_snapshots: DataFrame, cal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ETF closes on the *given* calendar, and the catalog (names on the newest non-empty day)."""
    on_days = etf_snapshots.join(F.broadcast(cal), "base_date")
    panel = on_days.where(F.col("close") > 0)
    newest = on_days.agg(F.min("age").alias("age"))
    catalog = on_days.join(F.broadcast(newest), "age").select("ticker", "name").distinct()
    return panel, catalog


def master_from_snapshot(snapshots: DataFrame, position: tuple[str, ...] = ()) -> DataFrame:
    """Security master of the newest day, before any screening filter.

    A ticker listed twice keeps its first row by ``position``; rows of equal position, or all of them
    without one, are ordered by their values, so that reruns agree.
    """
    newest = snapshots.agg(F.max("base_date").alias("base_date"))
    cols = [c for c in ("ticker", "name", "market", "market_cap", "sector")
            if c in snapshots.columns]
    rest = [c for c in cols if c != "ticker"]
    first = F.min_by(F.struct(*rest), F.struct(*position, *rest)).alias("r")
    day = snapshots.join(F.broadcast(newest), "base_date").groupBy("ticker").agg(first)
    return day.select(*[F.col(c) if c == "ticker" else F.col(f"r.{c}").alias(c) for c in cols])


def factor_proxies(specs: DataFrame, catalog: DataFrame, panel: DataFrame,
                   by_keyword: bool = True) -> DataFrame:
    """Best proxy product per factor: first keyword, then shortest name; or only the shortest name.

    ``specs(factor, keywords ARRAY, exclude ARRAY)`` is configuration, a handful of rows. The rank
    of a product is the position of the first keyword its name contains; a factor without a usable
    product keeps a row with a NULL ticker.
    """
    usable = (panel.groupBy("ticker").agg(F.count("close").alias("n")).where("n >= 2")
              .select("ticker"))
    hit = F.filter(F.sequence(F.lit(0), F.size("keywords") - 1),
                   lambda i: F.contains(F.col("name"), F.get(F.col("keywords"), i)))
    banned = F.exists("exclude", lambda x: F.contains(F.col("name"), x))
    named = catalog.where(F.col("name").isNotNull()).join(usable, "ticker", "left_semi")
    matches = (named.join(F.broadcast(specs), ~banned & (F.size(hit) > 0))
               .withColumn("kw_rank", F.get(hit, F.lit(0))))
    best = (matches.groupBy("factor")
            .agg(F.min_by(F.struct("kw_rank", "ticker", "name"), F.struct(
                *(["kw_rank"] if by_keyword else []), F.length("name").alias("len"), "ticker", "name"))
                 .alias("b")))
    return (specs.select("factor").join(best, "factor", "left")
            .select("factor", F.col("b.ticker").alias("ticker"),
                    F.col("b.name").alias("proxy_name"),
                    F.col("b.kw_rank").alias("kw_rank"),
                    F.col("b.ticker").isNull().alias("rejected")))


def weekdays_back(end_date: str, n_days: int, slack: float = 1.12, pad: int = 12) -> Column:
    """Newest-first weekdays, enough to hold ``n_days`` trading days (an array expression)."""
    want = int(n_days * slack) + pad
    span = want // 5 * 7 + 14
    end = F.lit(end_date).cast("date")
    days = F.sequence(end, F.date_sub(end, span), F.expr("interval -1 day"))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, want)
