"""Residual series and their lead/lag correlations. Prices score relations, never create them.

A series is packed into one row (positions and values, bounded by calendar length). A pair of
series then travels as two short arrays; the pairs of an Arrow batch are stacked as matrices with
masks, and the moments of all pairs at all lags are six products. Selection of the best lag is a
Column expression. Relations bring their pairs with them; the search
over unrelated pairs multiplies blocks of series, so that only pairs above the threshold ever
become rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline import settings as S
from tideline.functions import nodes as N
from tideline.functions.numbers import corr_t

CFG = S.LagSettings()
#: Positions of a matrix of series that are multiplied at a time.
CELLS = 1 << 20
PROFILE = "array<struct<lag:int,n:int,corr:double>>"


def residualize(series: DataFrame, market: DataFrame, cal: DataFrame,
                min_obs: int = CFG.min_obs) -> DataFrame:
    """series(name, dt_idx, ret, ...) minus its market part.

    Market variance is taken over the whole calendar with gaps as zero; the covariance only over
    observed days. A series with fewer than ``min_obs`` days, or a market too thin or too flat,
    passes through unchanged.
    """
    c = F.col
    mkt = (cal.select("dt_idx").join(
        F.broadcast(market.select("dt_idx", c("ret").alias("mr"))), "dt_idx", "left")
        .select("dt_idx", F.coalesce("mr", F.lit(0.0)).alias("m"),
                c("mr").isNotNull().cast("int").alias("has")))
    var = mkt.agg((F.avg(c("m") * c("m")) - F.avg("m") * F.avg("m")).alias("var"),
                  F.sum("has").alias("n_mkt"))
    obs = series.where(c("ret").isNotNull()).join(F.broadcast(mkt), "dt_idx")
    cov = obs.groupBy("name").agg(
        F.count("*").alias("n"),
        F.covar_pop("ret", "m").alias("cov"))
    usable = (c("n") >= min_obs) & (c("n_mkt") >= min_obs) & (c("var") > 0)
    beta = cov.join(F.broadcast(var)).select(
        "name", F.when(usable, c("cov") / c("var")).otherwise(F.lit(0.0)).alias("b"))
    return obs.join(beta, "name").select(
        *[x for x in series.columns if x != "ret"], (c("ret") - c("b") * c("m")).alias("ret"))


def to_blocks(series: DataFrame, days: int = CFG.block_days) -> DataFrame:
    """(name, dt_idx, ret, label): non-overlapping sums over ``days`` rows, newest rows first.

    Days on which no series is observed are removed before counting; the oldest incomplete block is
    discarded; a block needs half of its days observed. ``dt_idx`` becomes the block position.
    """
    seen = series.where(F.col("ret").isNotNull())
    newest = Window.orderBy(F.col("dt_idx").desc())
    # one row per calendar day
    days_seen = (seen.select("dt_idx").distinct()
                 .withColumn("rn", F.row_number().over(newest) - 1)
                 .withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
                 .withColumn("blk", F.floor(F.col("rn") / days))
                 .where(F.col("blk") < F.floor(F.col("n") / days)))
    days_seen = days_seen.withColumn(
        "label", F.max("dt_idx").over(Window.partitionBy("blk"))).withColumn(
        "pos", (F.floor(F.col("n") / days) - 1 - F.col("blk")).cast("int"))
    sums = seen.join(F.broadcast(days_seen.select("dt_idx", "pos", "label")), "dt_idx").groupBy(
        "name", "pos", "label").agg(F.sum("ret").alias("ret"), F.count("ret").alias("n"))
    return sums.where(F.col("n") >= days // 2).select(
        "name", F.col("pos").alias("dt_idx"), "ret", "label")


def pack(series: DataFrame) -> DataFrame:
    """(name, idx ARRAY, val ARRAY) in calendar order; as long as the calendar at most."""
    rows = series.where(F.col("ret").isNotNull()).groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("dt_idx", "ret"))).alias("s"))
    return rows.select("name", F.col("s.dt_idx").alias("idx"), F.col("s.ret").alias("val"))


def _dense(idx, val, lo: int, hi: int) -> np.ndarray:
    out = np.full(hi - lo + 1, np.nan)
    out[np.asarray(idx, dtype=int) - lo] = val
    return out


def _stacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, position and value of every observation of the series in columns ``at`` and ``at + 1``."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    return (np.repeat(np.arange(batch.num_rows), sizes), batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            batch.column(at + 1).flatten().to_numpy(zero_copy_only=False))


def _side_by_side(batch: pa.RecordBatch, at: int, squeeze: bool) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Both series of every pair as rows of two matrices and of two masks, from a common first position; and their lengths."""
    both = [_stacked(batch, at), _stacked(batch, at + 2)]
    lo = np.full(batch.num_rows, np.iinfo(np.int64).max)
    hi = np.full(batch.num_rows, -1)
    for row, idx, _ in both:
        np.minimum.at(lo, row, idx)
        np.maximum.at(hi, row, idx)
    length = hi - lo + 1
    values, seen = [], []
    for row, idx, val in both:
        m = np.zeros((batch.num_rows, int(length.max())))
        v = m.copy()
        m[row, idx - lo[row]] = 1.0
        v[row, idx - lo[row]] = val
        values.append(v)
        seen.append(m)
    if squeeze:
        keep = (seen[0] + seen[1]) > 0
        length = keep.sum(axis=1)
        rows, old = np.nonzero(keep)
        place = (np.cumsum(keep, axis=1) - 1)[rows, old]

        def moved(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), int(length.max())))
            out[rows, place] = x[rows, old]
            return out

        values, seen = [moved(x) for x in values], [moved(x) for x in seen]
    return values, seen, length


def cross_moments(values: list[np.ndarray], seen: list[np.ndarray], max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Joint observations and correlations (pairs x lags) of a[t - lag] with b[t], for all pairs and lags at once.

    Unseen positions are zero in ``values`` and ``seen``. The second series and its mask are looked at
    through a window that slides over the lags, so every moment is one product over all pairs. Values
    are centred first; a variance under 1e-12 of the squares it comes from is rounding residue.
    """
    (x, y), (m, w) = values, seen
    x = (x - x.sum(axis=1, keepdims=True) / np.maximum(m.sum(axis=1, keepdims=True), 1)) * m
    y = (y - y.sum(axis=1, keepdims=True) / np.maximum(w.sum(axis=1, keepdims=True), 1)) * w
    size = x.shape[1]

    def slid(z: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(np.pad(z, ((0, 0), (max_lag, max_lag))), size, axis=1)

    over = lambda u, z: np.einsum("pt,plt->pl", u, slid(z))
    n, sx, sy, sxy = over(m, w), over(x, w), over(m, y), over(x, y)
    sxx, syy = over(x * x, w), over(m, y * y)
    with np.errstate(all="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        told = (n >= 2) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
        corr = np.where(told, (sxy - sx * sy / n) / np.sqrt(vx * vy), np.nan)
    return np.rint(n).astype(np.int32), np.clip(corr, -1.0, 1.0)


def _profiles(kept: int, max_lag: int, squeeze: bool):
    """Task function: the first ``kept`` columns of a pair and its profile over lags -max_lag..max_lag, shorter for short series."""
    lags = np.arange(-max_lag, max_lag + 1, dtype=np.int32)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            span = int(np.ptp(np.concatenate([_stacked(batch, k)[1] for k in (kept, kept + 2)]))) + 1
            step = max(1, CELLS // span)
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                values, seen, length = _side_by_side(part, kept, squeeze)
                n, corr = cross_moments(values, seen, max_lag)
                inside = np.abs(lags)[None, :] < length[:, None]
                ends = np.concatenate([[0], np.cumsum(inside.sum(axis=1))]).astype(np.int32)
                lag = np.broadcast_to(lags, inside.shape)[inside]
                told = pa.StructArray.from_arrays([pa.array(lag), pa.array(n[inside]), pa.array(corr[inside], mask=np.isnan(corr[inside]))], ["lag", "n", "corr"])
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.ListArray.from_arrays(ends, told)], names=[*part.schema.names[:kept], "profile"])

    return run


def pair_profiles(pairs: DataFrame, packed: DataFrame, max_lag: int,
                  squeeze: bool = False) -> DataFrame:
    """pairs(a, b) with both series present, plus their lag profile.

    ``squeeze`` first removes positions at which both series are missing.
    """
    left = packed.select(F.col("name").alias("a"), F.col("idx").alias("ia"), F.col("val").alias("va"))
    right = packed.select(F.col("name").alias("b"), F.col("idx").alias("ib"), F.col("val").alias("vb"))
    j = pairs.join(left, "a").join(right, "b").select(*pairs.columns, "ia", "va", "ib", "vb")
    told = T.StructType([*j.schema.fields[:len(pairs.columns)], T.StructField("profile", T.DataType.fromDDL(PROFILE))])
    return j.mapInArrow(_profiles(len(pairs.columns), max_lag, squeeze), told)


def best_lag(profile: Column, min_obs: int) -> Column:
    """STRUCT(t, lag, corr, n) of the lag with most evidence; NULL when nothing qualifies.

    Ties go to the shorter lag, then to the negative one. lag > 0 means the first series leads.
    """
    fit = F.filter(profile, lambda p: (p["n"] >= min_obs) & p["corr"].isNotNull())
    scored = F.transform(fit, lambda p: F.struct(
        corr_t(p["corr"], p["n"]).alias("t"), (-F.abs(p["lag"])).alias("short"),
        (-p["lag"]).alias("neg"), p["lag"].alias("lag"), p["corr"].alias("corr"), p["n"].alias("n")))
    return F.array_max(scored)


def best_lags(profiles: DataFrame, min_obs: int = CFG.min_obs) -> DataFrame:
    """lag, corr, n of the best lag of every profile; pairs that cannot be measured are absent."""
    rest = [c for c in profiles.columns if c != "profile"]
    prof = profiles.withColumn("best", best_lag(F.col("profile"), min_obs))
    return prof.where(F.col("best").isNotNull()).select(
        *rest, F.col("best.lag").alias("lag"), F.col("best.corr").alias("corr"), F.col("best.n").alias("n"))


def lead_lag(pairs: DataFrame, packed: DataFrame, max_lag: int = CFG.max_lag,
             min_obs: int = CFG.min_obs, squeeze: bool = False) -> DataFrame:
    """pairs(a, b, ...) -> lag, corr, n of the best lag; pairs that cannot be measured are absent."""
    return best_lags(pair_profiles(pairs, packed, max_lag, squeeze), min_obs)


def industry_pairs(edges: DataFrame) -> DataFrame:
    """Distinct ordered (a, b) of industry -> industry edges."""
    both = (N.node_kind(F.col("src")) == "I") & (N.node_kind(F.col("dst")) == "I")
    return edges.where(both).select(N.node_value(F.col("src")).alias("a"),
                                    N.node_value(F.col("dst")).alias("b")).distinct()


def score_edges(edges: DataFrame, series: DataFrame, max_lag: int = CFG.max_lag,
                min_obs: int = CFG.min_obs) -> DataFrame:
    """Every edge, with price_corr / price_lag / price_obs where both ends have a series.

    Each unordered pair is measured once; the opposite direction mirrors the lag.
    """
    return with_price_lags(edges, lead_lag(once_per_pair(industry_pairs(edges)), pack(series), max_lag, min_obs))


def with_price_lags(edges: DataFrame, measured: DataFrame) -> DataFrame:
    """Every edge with the best lag of its pair of industries out of ``measured(a, b, lag, corr, n)``."""
    ll = measured_both_ways(measured)
    return edges.withColumns({"_a": N.node_value(F.col("src")), "_b": N.node_value(F.col("dst")),
                              "_k": F.concat(N.node_kind(F.col("src")), N.node_kind(F.col("dst")))
                              }).join(
        ll.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit("II").alias("_k"),
                  F.round("corr", 3).alias("price_corr"), F.col("lag").alias("price_lag"),
                  F.col("n").alias("price_obs")), ["_a", "_b", "_k"], "left").drop("_a", "_b", "_k")


def once_per_pair(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
        F.col("a") != F.col("b")).distinct()


def measured_both_ways(measured: DataFrame) -> DataFrame:
    """The measured rows and their mirror image: ends swapped, lag negated."""
    back = measured.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("lag")).alias("lag"),
                           "corr", "n")
    return (measured.select("a", "b", "lag", "corr", "n").withColumn("mirrored", F.lit(False))
            .unionByName(back.withColumn("mirrored", F.lit(True))))


def member_overlap(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """pairs(a, b) plus the Jaccard overlap of their members (0 when either is empty)."""
    m = members.select("industry", "ticker").distinct()
    sizes = m.groupBy("industry").agg(F.count("*").alias("k"))
    common = (pairs.join(m.select(F.col("industry").alias("a"), "ticker"), "a")
              .join(m.select(F.col("industry").alias("b"), "ticker"), ["b", "ticker"], "left_semi")
              .groupBy("a", "b").agg(F.count("*").alias("both")))
    j = (pairs.join(sizes.select(F.col("industry").alias("a"), F.col("k").alias("ka")), "a", "left")
         .join(sizes.select(F.col("industry").alias("b"), F.col("k").alias("kb")), "b", "left")
         .join(common, ["a", "b"], "left"))
    shared = F.coalesce(F.col("both"), F.lit(0))
    return j.select("a", "b", F.coalesce(F.try_divide(
        shared, F.col("ka") + F.col("kb") - shared), F.lit(0.0)).alias("overlap"))


def cycle_lags(edges: DataFrame, daily: DataFrame, members: DataFrame,
               cfg: S.LagSettings = CFG) -> DataFrame:
    """Slow lead/lag of every related industry pair, both directions.

    (a, b, lag, corr, n, overlap, skipped, mirrored). Pairs whose members overlap too much carry a
    reason instead of a measurement. The direction of an edge decides which row is the mirror.
    """
    blocks = to_blocks(daily.select("name", "dt_idx", "ret"), cfg.block_days)
    have = blocks.select("name").distinct()
    directed = industry_pairs(edges).where(F.col("a") != F.col("b"))
    # of the two directions of a pair, the first by name is the measured one
    pairs = (once_per_pair(directed)
             .join(have.select(F.col("name").alias("a")), "a", "left_semi")
             .join(have.select(F.col("name").alias("b")), "b", "left_semi"))
    seen = member_overlap(pairs, members)
    apart = seen.where(F.col("overlap") < cfg.max_overlap)
    ll = lead_lag(apart, pack(blocks), cfg.max_lag_blocks, cfg.min_obs_blocks, squeeze=True)
    measured = ll.withColumn("skipped", F.lit(None).cast("string"))
    skipped = seen.where(F.col("overlap") >= cfg.max_overlap).select(
        "a", "b", "overlap", F.lit(None).cast("int").alias("lag"),
        F.lit(None).cast("double").alias("corr"), F.lit(None).cast("int").alias("n"),
        F.lit(S.SKIP_OVERLAP).alias("skipped"))
    one_way = measured.unionByName(skipped)
    back = one_way.withColumns({"a": F.col("b"), "b": F.col("a"), "lag": -F.col("lag")})
    return (one_way.withColumn("mirrored", F.lit(False))
            .unionByName(back.withColumn("mirrored", F.lit(True))))


def attach_cycle_lags(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Edges with cycle_lag_months / cycle_corr; skipped pairs attach nothing."""
    hit = table.where(F.col("lag").isNotNull()).select(
        N.industry_node(F.col("a")).alias("src"), N.industry_node(F.col("b")).alias("dst"),
        F.col("lag").alias("cycle_lag_months"), F.round("corr", 3).alias("cycle_corr"))
    return edges.join(hit, ["src", "dst"], "left")


def review_queue(scored: DataFrame, weak: float = CFG.weak_corr) -> DataFrame:
    """Edges that prices do not support, weakest first: a list to look at, not to delete."""
    return scored.where(F.abs("price_corr") < weak).select(
        "src", "dst", "rel", "source", "origin", "price_corr", "price_obs",
        F.coalesce("evidence", F.lit("")).alias("evidence")
    ).orderBy(F.abs("price_corr"), "src", "dst", "rel", "source", "origin")


def lag_table_top(table: DataFrame, limit: int = 12) -> DataFrame:
    return table.where(~F.col("mirrored") & F.col("lag").isNotNull()).orderBy(
        F.abs("corr").desc(), "a", "b").limit(limit)


def _block_search(max_lag: int, min_obs: int, n_pairs: int):
    """Task function: strongest lag of every pair across two blocks, above-threshold rows only."""
    floor = 2.575 + np.sqrt(np.log(max(n_pairs, 1)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("name").sort_values("name")
        hi = max(i[-1] for i in pdf["idx"])
        dense = np.vstack([_dense(i, v, 0, hi) for i, v in zip(pdf["idx"], pdf["val"])])
        names, blocks = pdf["name"].to_numpy(), pdf["blk"].to_numpy()
        seen = (~np.isnan(dense)).astype(float)
        x = np.where(np.isnan(dense), 0.0, dense)
        k = len(names)
        best_t, best = np.full((k, k), -1.0), {f: np.zeros((k, k)) for f in ("lag", "corr", "n")}
        # short lags first, negative before positive, so a later tie never replaces an earlier one
        for lag in sorted(range(-max_lag, max_lag + 1), key=lambda g: (abs(g), g)):
            if abs(lag) > hi:
                continue
            cut_a = slice(0, hi + 1 - lag) if lag >= 0 else slice(-lag, hi + 1)
            cut_b = slice(lag, hi + 1) if lag >= 0 else slice(0, hi + 1 + lag)
            xa, ma, xb, mb = x[:, cut_a], seen[:, cut_a], x[:, cut_b], seen[:, cut_b]
            n = ma @ mb.T
            with np.errstate(all="ignore"):
                sa, sb = xa @ mb.T, ma @ xb.T
                va = (xa * xa) @ mb.T - sa * sa / n
                vb = ma @ (xb * xb).T - sb * sb / n
                r = np.where((va > 0) & (vb > 0), (xa @ xb.T - sa * sb / n) / np.sqrt(va * vb), np.nan)
                capped = np.minimum(np.abs(r), 0.999999)
                t = np.where(n < 3, 0.0, np.abs(r) * np.sqrt(n - 2) / np.sqrt(1 - capped * capped))
            take = (n >= min_obs) & ~np.isnan(r) & (t > best_t)
            best_t = np.where(take, t, best_t)
            for f, v in (("lag", np.full((k, k), lag)), ("corr", r), ("n", n)):
                best[f] = np.where(take, v, best[f])
        with np.errstate(all="ignore"):
            bar = np.where(best["n"] > 3, np.minimum(0.99, np.tanh(floor / np.sqrt(best["n"] - 3))), 1.0)
        lo, up = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        here = ((blocks[:, None] == lo) & (blocks[None, :] == up)) | (
            (blocks[:, None] == up) & (blocks[None, :] == lo))
        ordered = names[:, None] < names[None, :]
        i, j = np.nonzero(here & ordered & (best_t >= 0) & (np.abs(best["corr"]) >= bar))
        return pd.DataFrame({"a": names[i], "b": names[j], "lag": best["lag"][i, j].astype("int32"),
                             "corr": best["corr"][i, j], "n": best["n"][i, j].astype("int32")})
    return search


def discover(series: DataFrame, edges: DataFrame, cfg: S.LagSettings = CFG,
             block_size: int = 256) -> DataFrame:
    """All unordered pairs above the many-comparisons threshold that no edge links yet.

    Series are dealt into blocks of about ``block_size``; one task holds two blocks and multiplies
    them lag by lag. No pair below the threshold leaves a task.
    """
    packed = pack(series)
    n_series = packed.count()
    n_blocks = max(1, -(-n_series // block_size))
    n_pairs = max(1, n_series * (n_series - 1) // 2)
    dealt = packed.withColumn("blk", F.pmod(F.xxhash64("name"), F.lit(n_blocks)).cast("int"))
    spread = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        "name", "idx", "val", "blk", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"))
    found = spread.groupBy("lo", "hi").applyInPandas(
        _block_search(cfg.max_lag, cfg.min_obs, n_pairs),
        "a string, b string, lag int, corr double, n int")
    linked = once_per_pair(industry_pairs(edges))
    return found.join(linked, ["a", "b"], "left_anti")


def discovery_top(found: DataFrame, limit: int = CFG.discovery_limit) -> DataFrame:
    return found.orderBy(F.abs("corr").desc(), "a", "b").limit(limit)


