"""Exact top-k inner products by MaxScore over shards (operator 9).

Vectors are dense, so a term is one dimension and a shard's posting list is its column of values. For
a query, dimension d adds between low_d and high_d, the extremes of q_d * v_d over the shard; the
score is the sum of the lows plus non-negative excesses with bounds high_d - low_d, to which MaxScore
applies: the terms of smallest bounds whose bounds together can't lift a vector to the k-th best score
are non-essential. Essential columns are traversed for all vectors of the shard; the other columns
are probed, largest bound first, for the vectors that are still competitive. Shards' lists are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Sink, arrow_rows, staged

#: Vectors in a shard and queries in a block; a task holds one of each.
SHARD, BLOCK = 4096, 4096
#: Each block of queries is sent to so many places, which share the shards among them.
SALTS = 24
#: Non-essential columns probed at a time.
PROBE = 8
EXACT = float(1 << 53)


def quantized(vectors: DataFrame, ids: str, values: str, factor: int = 256) -> DataFrame:
    """(id long, v array<long>) with floor(factor * x); rows with null or non-finite parts take no part."""
    value = F.col(values)
    usable = value.isNotNull() & F.col(ids).isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(usable).select(F.col(ids).cast("long").alias("id"), F.transform(value, lambda x: F.floor(x.cast("double") * factor).cast("long")).alias("v"))


def numbered(vectors: DataFrame) -> DataFrame:
    """Adds row, a number of its own for every row, and writes the table, so that the number stays."""
    return staged(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _packed(size: int):
    schema = pa.schema([("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("v", pa.binary())])

    def pack(batches):
        out, ids, vs = Sink(schema, 4), [], []

        def flush():
            dims = max(map(len, vs))
            block = np.zeros((len(vs), dims), np.int64)
            for row, v in zip(block, vs):
                row[:len(v)] = v
            out.add(len(vs), dims, np.array(ids, np.int64).tobytes(), block.tobytes())
            ids.clear()
            vs.clear()

        for row, own, v in arrow_rows(batches):
            ids.append((row, own))
            vs.append(v)
            if len(vs) == size:
                flush()
            if out.full:
                yield out.take()
        if vs:
            flush()
        yield out.take()

    return pack


def _unpacked(n: int, dims: int, ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64).reshape(n, 2), np.frombuffer(v, np.int64).reshape(n, dims)


def search_shard(own: np.ndarray, shard: np.ndarray, query_row: int, query: np.ndarray, k: int, extremes=None) -> list[tuple[int, int]]:
    """The k best (vec_id, score) of a shard for one query, ties to the smaller id; `own` has row and id of each vector, and the query's own row is no candidate."""
    row, ids = own[:, 0], own[:, 1]
    low, high = extremes if extremes is not None else (shard.min(axis=0), shard.max(axis=0))
    a, b = query * low, query * high
    least, bound = np.minimum(a, b), np.abs(b - a)
    order = np.argsort(-bound, kind="stable")
    rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # what the terms from here on can add at most
    rows = np.flatnonzero(row != query_row)
    if not len(rows):
        return []
    base = least.sum()
    # a first threshold: whole scores of the rows that are best in a quarter of the terms
    head = order[: max(1, len(order) // 4)]
    part = shard[:, head] @ query[head]
    guess = rows[np.argpartition(-part[rows], min(k, len(rows)) - 1)[:k]]
    floor = np.sort(shard[guess] @ query)[0] if len(rows) > k else np.iinfo(np.int64).min
    # essential: without them, the bounds of the others stay below the threshold
    essential = int(np.searchsorted(-(base + rest), -floor, side="right")) if len(rows) > k else len(order)
    essential = max(len(head), min(essential, len(order)))
    got = part + shard[:, order[len(head):essential]] @ query[order[len(head):essential]]
    lows = np.append(np.cumsum(least[order][::-1])[::-1], 0)
    at, got = essential, got[rows]
    while True:
        alive = got + lows[at] + rest[at] >= floor
        rows, got = rows[alive], got[alive]
        if at >= len(order):
            break
        more = order[at:at + PROBE]
        got = got + shard[np.ix_(rows, more)] @ query[more]
        at += len(more)
    best = np.lexsort((ids[rows], -got))[:k]
    return [(int(ids[rows[i]]), int(got[i])) for i in best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Each query's k best candidates: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Both tables are (row, id, v), see `quantized` and `numbered`. Candidates are all rows but the
    query's own; fewer than k give fewer rows. Repeated rows and ids count as often as they occur, as
    candidates and as queries (whose result rows then repeat the query_id). Null vectors, vectors with
    null or non-finite components and null ids take no part. Shorter vectors are
    padded with zeros. Scores are exact within the range of a long. Empty tables give an empty result.
    Shards of candidates meet blocks of queries in an equi-join on the block's number; each pair of
    them is one bounded piece of work and sends at most k rows per query.
    """
    kinds = "n int, dims int, ids binary, v binary"
    queries, vectors = queries.select("row", "id", "v"), vectors.select("row", "id", "v")
    blocks = queries.mapInArrow(_packed(block), kinds).withColumn("block", F.monotonically_increasing_id())
    blocks = staged(blocks.select("block", *(F.col(c).alias(f"q_{c}") for c in ("n", "dims", "ids", "v"))), "blocks")
    numbers = [r[0] for r in blocks.select("block").collect()]  # one number per block of queries
    shards = vectors.mapInArrow(_packed(shard), kinds).withColumn("salt", F.pmod(F.monotonically_increasing_id() + F.shiftrightunsigned(F.monotonically_increasing_id(), 33), F.lit(SALTS)))
    shards = shards.withColumn("block", F.explode(F.lit(numbers).cast("array<long>")))
    met = shards.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["block", "salt"])
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        out = Sink(schema)
        for n, dims, ids, v, q_n, q_dims, q_ids, q_v in arrow_rows(batches):
            (own, held), (q_own, asked) = _unpacked(n, dims, ids, v), _unpacked(q_n, q_dims, q_ids, q_v)
            width = min(dims, q_dims)
            held, asked = held[:, :width], asked[:, :width]
            if width and float(np.abs(held).max()) * float(np.abs(asked).max()) * width < EXACT:
                held, asked = np.asfortranarray(held, dtype=np.float64), asked.astype(np.float64)  # exact, and fast to multiply
            extremes = (held.min(axis=0), held.max(axis=0)) if width else None
            for (query_row, query_id), query in zip(q_own.tolist(), asked):
                found = search_shard(own, held, query_row, query, k, extremes) if width else [(int(i), 0) for i in np.sort(own[own[:, 0] != query_row, 1])[:k]]
                for vec_id, score in found:
                    out.add(query_row, query_id, vec_id, score)
                if out.full:
                    yield out.take()
        yield out.take()

    found = met.select("n", "dims", "ids", "v", "q_n", "q_dims", "q_ids", "q_v").mapInArrow(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
