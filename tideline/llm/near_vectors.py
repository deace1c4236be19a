"""Embedding near-dedup by binary codes of random rotations with correction factors (operator 11).

A unit vector x is turned by several random rotations; the signs of all turned components are its
binary code. Read back, the signs of rotation i give a vector v_i = f_i x + o_i whose factor
f_i = <v_i, x> is stored, and whose rest o_i is orthogonal to x and, over rotations, of random
direction. With the rotations in two halves A and B, independent of each other,
    (<A(x), B(y)> + <B(x), A(y)>) / (F_A(x) F_B(y) + F_B(x) F_A(y))
is an unbiased estimate of <x, y> from codes and factors alone. The lengths of the rests give its
standard error; only pairs whose estimate reaches the threshold within DEVIATIONS of it are computed
again from the vectors.

Codes are compared where they share all bits of a band. Bands have as many bits as keep buckets of
chance neighbours small, and there are as many bands as find a pair right at the threshold with
probability RECALL (pairs above it sooner). A pair counts in the first band that it shares, so no
pairs need to be written: a task sends one row per vector. Equal vectors are one class with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Sink, arrow_rows, batches_of, components, looked_up, staged

COSINE, RECALL, DEVIATIONS, SEED = 0.9, 0.999, 5.0, 20_011
#: Chance neighbours in a bucket aimed at, and vectors in a block; larger buckets meet block by block.
AIM, BLOCK = 256, 1024
#: Bits of a code at least.
CODE = 256
#: Rows that reach Python at a time, and pairs whose bands are compared at a time.
AT_ONCE, PAIRS = 2048, 1 << 16
_GROUP = ["width", "key", "i", "j"]


def banding(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a band, number of bands) for n distinct vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(30, max(8, math.ceil(math.log2(max(n, 1) / AIM))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree ** bits))


@lru_cache(maxsize=8)
def rotations(width: int, bits: int) -> np.ndarray:
    """An even number of random rotations with at least `bits` components in all: (rotations, width, width)."""
    n = max(2, 2 * math.ceil(max(bits, CODE) / width / 2))
    rng = np.random.default_rng([SEED, width])
    turned = []
    for _ in range(n):
        q, r = np.linalg.qr(rng.normal(size=(width, width)))
        turned.append(q * np.sign(np.diag(r)))
    return np.array(turned, np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their magnitude."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def codes(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and the two factors (n x 2) of unit rows."""
    turn = rotations(rows.shape[1], bits)
    turned = np.einsum("rab,nb->nra", turn, rows.astype(np.float32), optimize=True)
    factors = np.abs(turned).sum(axis=2) / math.sqrt(rows.shape[1])
    half = len(turn) // 2
    signs = np.packbits(turned.reshape(len(rows), -1) >= 0, axis=1)
    return signs, np.stack([factors[:, :half].sum(axis=1), factors[:, half:].sum(axis=1)], axis=1).astype(np.float32)


def bands(signs: np.ndarray, bits: int, number: int) -> np.ndarray:
    """The bits of every band as a number (n x bands)."""
    cut = np.unpackbits(signs, axis=1, count=bits * number).reshape(len(signs), number, bits)
    return cut.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


class Estimates:
    """Inner products of coded vectors: which pairs may reach the threshold."""

    def __init__(self, width: int, signs: np.ndarray, factors: np.ndarray, bits: int, cosine: float = COSINE):
        turn = rotations(width, bits)
        half = len(turn) // 2
        s = np.unpackbits(signs, axis=1, count=len(turn) * width).astype(np.float32) * 2 - 1
        s = s.reshape(len(signs), len(turn), width) / math.sqrt(width)
        a, b = (s[:, part].reshape(len(signs), -1) @ turn[part].reshape(-1, width) for part in (slice(0, half), slice(half, None)))
        fa, fb = factors[:, :1], factors[:, 1:]
        ra, rb = (np.maximum((v * v).sum(axis=1, keepdims=True) - f * f, 0) for v, f in ((a, fa), (b, fb)))
        self.left, self.right = np.hstack([a, b, -cosine * fa, -cosine * fb]), np.hstack([b, a, fb, fa])
        one, two = (1 - cosine * cosine) / max(width - 1, 1), 1 / max(width - 2, 1)
        self.spread = np.hstack([one * fa * fa, one * ra, one * fb * fb, one * rb, two * ra, two * rb])
        self.against = np.hstack([rb, fb * fb, ra, fa * fa, rb, ra])

    def pairs(self, x: slice, y: slice) -> np.ndarray:
        """True where the estimate is at the threshold, or below it by less than DEVIATIONS standard errors."""
        return self.left[x] @ self.right[y].T + DEVIATIONS * np.sqrt(self.spread[x] @ self.against[y].T) >= 0


def _first_met(a: np.ndarray, b: np.ndarray, own: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that share no band before this one."""
    keep = [np.zeros(0, bool)]
    for at in range(0, len(a), PAIRS):
        equal = own[a[at:at + PAIRS], :band] == own[b[at:at + PAIRS], :band]
        keep.append(~equal.any(axis=1))
    keep = np.concatenate(keep)
    return a[keep], b[keep]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows sorted by the first four columns, several groups at a time."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if batch.num_rows else rest
        if not batch.num_rows:
            continue
        cut = _starts(batch)[-1]
        if cut:
            yield batch.slice(0, cut)
        rest = batch.slice(cut)
    if rest is not None:
        yield rest


def _starts(batch: pa.RecordBatch, columns: int = 4) -> np.ndarray:
    keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(columns)], axis=1)
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, int]]]]:
    """Rows of one width with the spans of their groups: (start, start of the second block, end, band)."""
    wide = [*_starts(batch, 1).tolist(), batch.num_rows]
    for a, e in zip(wide, wide[1:]):
        part = batch.slice(a, e - a)
        key, i, j, block = (part.column(k).to_numpy(zero_copy_only=False) for k in range(1, 5))
        starts = [*_starts(part).tolist(), part.num_rows]
        spans = []
        for s, t in zip(starts, starts[1:]):
            middle = s if i[s] == j[s] else s + int(np.searchsorted(block[s:t], j[s]))
            spans.append((s, middle, t, int(key[s]) >> 32))
        yield part, spans


def _coded(bits: int, number: int):
    schema = pa.schema([("class", pa.int64()), ("width", pa.int32()), ("code", pa.binary()), ("fa", pa.float32()), ("fb", pa.float32()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            own, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            widths = v.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths)
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                rows = flat[(ends[at] - w)[:, None] + np.arange(w)]
                signs, factors = codes(unit(rows), bits * number)
                keys = bands(signs, bits, number) + (np.arange(number, dtype=np.int64) << 32)
                yield pa.record_batch([pa.array(own[at]), pa.array(np.full(len(at), w, np.int32)), pa.array([s.tobytes() for s in signs], pa.binary()),
                                       pa.array(factors[:, 0]), pa.array(factors[:, 1]), pa.array(list(keys), pa.list_(pa.int64()))], schema=schema)

    return run


def _signs(part: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(part.column(column).to_pylist()), np.uint8).reshape(part.num_rows, -1)


def _candidates(bits: int, number: int, cosine: float):
    """Of every bucket, the vectors with a partner that may be near."""
    schema = pa.schema([("width", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("class", pa.int64())])

    def run(batches):
        for batch in _groups(batches):
            for part, spans in _spans(batch):
                signs = _signs(part, "code")
                factors = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("fa", "fb")], axis=1)
                own, keep = bands(signs, bits, number), np.zeros(part.num_rows, bool)
                told = Estimates(part.column("width")[0].as_py(), signs, factors, bits * number, cosine)
                for s, m, t, band in spans:
                    if t - s < 2:
                        continue
                    near = told.pairs(slice(s, t), slice(s, t)) if m == s else told.pairs(slice(s, m), slice(m, t))
                    a, b = np.nonzero(np.triu(near, 1) if m == s else near)
                    a, b = _first_met(a + s, b + m, own, band)
                    keep[a] = keep[b] = True
                yield pa.record_batch([part.column(f.name) for f in schema], schema=schema).filter(pa.array(keep))

    return run


def _links(bits: int, number: int, cosine: float):
    """Exact links: per vector and bucket the number of vectors linked, and the group's smallest class reached."""
    schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def run(batches):
        out = Sink(schema)
        for batch in _groups(batches):
            for part, spans in _spans(batch):
                width = part.column("width")[0].as_py()
                own = bands(_signs(part, "code"), bits, number)
                rows = unit(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width))
                ids, weight = (part.column(c).to_numpy(zero_copy_only=False) for c in ("class", "n"))
                for s, m, t, band in spans:
                    if t - s < 2:
                        continue
                    near = rows[s:t] @ rows[s:t].T >= cosine if m == s else rows[s:m] @ rows[m:t].T >= cosine
                    a, b = np.nonzero(np.triu(near, 1) if m == s else near)
                    a, b = _first_met(a + s, b + m, own, band)
                    if not len(a):
                        continue
                    counts = np.zeros(t - s, np.int64)
                    np.add.at(counts, a - s, weight[b])
                    np.add.at(counts, b - s, weight[a])
                    low, before = ids[s:t].copy(), None
                    while before is None or (before != low).any():
                        before = low.copy()
                        np.minimum.at(low, a - s, before[b - s])
                        np.minimum.at(low, b - s, before[a - s])
                    for k in np.flatnonzero(counts).tolist():
                        out.add(int(ids[s + k]), int(counts[k]), int(low[k]))
                    if out.full:
                        yield out.take()
        yield out.take()

    return run


def near_vectors(vectors: DataFrame, ids: str = "vec_id", values: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    n_links is the number of other vectors with a cosine of at least `cosine`, component_id the
    smallest id reachable over such links and kept says whether it is the row's own. Links found are
    exact; one right at the threshold is found with probability `recall`. Vectors that are null, zero
    or hold null or non-finite components, and vectors of different widths, link with nothing.
    Repeated rows and equal vectors link with each other. A null id never names a group that has
    another id; groups without any id keep all their rows. Empty tables give no rows. Classes of
    equal vectors are told apart by 64-bit hashes of their components. Other columns are not read.
    """
    spark = vectors.sparkSession
    # 0.0 is added since -0.0 is the same number with other bits
    v = F.transform(values, lambda x: x.cast("double") + F.lit(0.0))
    usable = F.col(values).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(ids).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable"))
    used = rows.where("usable").select("vec_id", F.xxhash64("v").alias("class"), "v")
    classes = staged(used.groupBy("class").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("low")), "classes")
    bits, number = banding(classes.count(), cosine, recall)
    kinds = "class long, width int, code binary, fa float, fb float, keys array<long>"
    with batches_of(spark, AT_ONCE):
        coded = staged(classes.select("class", "v").mapInArrow(_coded(bits, number), kinds), "codes")
        keyed = coded.select("class", "width", "code", "fa", "fb", F.explode("keys").alias("key"))
        sizes = coded.select("width", F.explode("keys").alias("key")).groupBy("width", "key").agg(F.count("*").alias("size"))
        large = staged(sizes.where(F.col("size") > BLOCK), "large")
        met = looked_up(keyed, large, ["width", "key"])
        blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
        met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("width", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "code", "fa", "fb")
        found = met.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "block").mapInArrow(_candidates(bits, number, cosine), "width int, key long, i int, j int, block int, class long")
        found = staged(found, "candidates")
        whole = coded.select("class", "code").join(classes.select("class", "v", "n"), "class")
        whole = looked_up(found, whole, ["class"], "inner", grows=True).select(*_GROUP, "block", "class", "code", "v", "n")
        links = staged(whole.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "block").mapInArrow(_links(bits, number, cosine), "class long, n long, to long"), "links")
    degrees = links.groupBy("class").agg(F.sum("n").alias("links"))
    comps = components(links.select(F.col("class").alias("a"), F.col("to").alias("b")))
    told = classes.select("class", "n", "low").join(degrees, "class", "left").where("n > 1 or links is not null").join(comps.withColumnRenamed("node", "class"), "class", "left")
    told = staged(told.withColumn("label", F.coalesce("label", "class")), "told")
    lows = told.groupBy("label").agg(F.min("low").alias("component"))
    odd = staged(told.join(lows, "label").select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"), "odd")
    out = looked_up(used.select("vec_id", "class"), odd, ["class"])
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"))
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
