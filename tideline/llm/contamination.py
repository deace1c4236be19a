"""Benchmark decontamination by size-partitioned MinHash containment (operator 6).

Test items are short and documents may be very long, so a document as a whole has a tiny Jaccard
similarity with an item that it holds. Items are parted by their number of shingles into classes of
ratio two; for each class, documents are cut into half-overlapping windows of twice the class's
largest size. Any run of that many shingles lies within one window, where containment 0.8 means a
Jaccard similarity of 0.19 at least. An item is a candidate where one of HASHES minima agrees
(missed with probability 0.81 ** 64 = 1.4e-6), and is then verified by exact shingle containment.
A document with fewer of the items' shingles than the smallest item of a class needs can hold none of
that class, so its windows are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Sink, arrow_rows, id_key, looked_up, packed, lowered_words, staged, text_key

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 64
#: Bits of the two filters that are broadcast, 1 MB each whatever the number of items.
FILTER_BITS = 23
#: Numbers in memory while minima are taken.
BLOCK = 1 << 18
_random = np.random.default_rng(2024)
MULTIPLY = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
ADD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all n-word shingles; of the whole sequence if there are fewer words; none for none."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    ids = pd.util.hash_array(np.array(words, object), categorize=False)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ ids[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def minima(parts: np.ndarray) -> np.ndarray:
    """Smallest value of a set of shingles under each of the HASHES permutations, in blocks."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(parts), BLOCK // HASHES):
        out = np.minimum(out, (parts[None, at:at + BLOCK // HASHES] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return out


def size_class(n: int) -> int:
    return max(0, int(n - 1).bit_length())


def _band(cls: int, k: int, value: int) -> int:
    """Key of one minimum in one size class, as a signed long."""
    return xxhash.xxh64_intdigest(int(value).to_bytes(8, "little"), cls * HASHES + k) - (1 << 63)


def _bits(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(keys: DataFrame) -> np.ndarray:
    """Bit set over the upper bits of long keys: at most 2 ** FILTER_BITS distinct positions reach the driver."""
    at = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("at")).distinct().toPandas()["at"].to_numpy(np.int64)
    found = np.zeros(1 << FILTER_BITS, bool)
    found[at] = True
    return np.packbits(found)


def _index_items(batches):
    schema = pa.schema([("item", pa.int64()), ("cls", pa.int32()), ("n", pa.int64()), ("parts", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    out = Sink(schema, 500)
    for item, text in arrow_rows(batches):
        parts = np.unique(shingles(lowered_words(text)))
        if len(parts):
            cls = size_class(len(parts))
            out.add(item, cls, len(parts), parts.view(np.int64).tolist(), [_band(cls, k, v) for k, v in enumerate(minima(parts))])
        if out.full:
            yield out.take()
    yield out.take()


FOUND = pa.schema([("id_key", pa.string()), ("text_key", pa.int64()), ("doc_id", pa.int64()), ("hits", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _search(shared):
    """Documents that share a minimum with some item: all their shingles that items may have, and the minima met."""
    def run(batches):
        classes, parts_bits, bands_bits = shared.value
        known, known_bands = np.unpackbits(parts_bits).view(bool), np.unpackbits(bands_bits).view(bool)
        out = Sink(FOUND, 2_000)
        for key, text_key_, doc_id, text in arrow_rows(batches):
            parts = shingles(lowered_words(text))
            at = np.flatnonzero(known[_bits(parts)])
            if not len(at):
                continue
            hits = np.unique(parts[at])
            bands: set[int] = set()
            for cls, needed in classes:
                if len(hits) < needed:
                    continue
                step = 1 << cls
                # a window's minimum can equal an item's only if that shingle is in the window: others are not looked at
                for w in np.unique(np.concatenate([at // step, np.maximum(at // step - 1, 0)])):
                    window = parts[w * step:(w + 2) * step]
                    for k, value in enumerate(minima(window)):
                        band = _band(cls, k, value)
                        if known_bands[(band & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)]:
                            bands.add(band)
            if bands:
                out.add(key, text_key_, doc_id, hits.view(np.int64).tolist(), sorted(bands))
            if out.full:
                yield out.take()
        yield out.take()

    return run


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Test items inside documents: id_key, text_key, doc_id, item_id, shared, item_shingles, containment.

    Containment is the share of an item's distinct five-word shingles that the document has, over
    ASCII-lowered words. An item of fewer words is one shingle, its whole sequence, and so is a
    document. Null and empty texts match nothing. One row per distinct (doc_id, text) and distinct
    (item_id, text); repeated rows add none. Null ids are kept. Empty tables give an empty result.
    """
    items = items.select("item_id", "text").distinct().withColumn("item", F.xxhash64(id_key(F.col("item_id")), text_key(F.col("text"))))
    indexed = staged(items.select("item", F.col("text").cast("binary").alias("text"))
                     .mapInArrow(_index_items, "item long, cls int, n long, parts array<long>, bands array<long>"), "items")
    item_parts = indexed.select("item", "n", F.explode("parts").alias("key"))
    item_bands = indexed.select("item", F.explode("bands").alias("key"))
    classes = sorted((r["cls"], threshold * r["n"] - 1e-9) for r in indexed.groupBy("cls").agg(F.min("n").alias("n")).collect())
    shared = docs.sparkSession.sparkContext.broadcast((classes, _filter(item_parts), _filter(item_bands)))
    rows = docs.select(id_key(F.col("doc_id")).alias("id_key"), text_key(F.col("text")).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = staged(rows.mapInArrow(_search(shared), "id_key string, text_key long, doc_id long, hits array<long>, bands array<long>"), "found")
    own = ["id_key", "text_key", "doc_id"]
    candidates = found.select(*own, F.explode("bands").alias("key")).join(item_bands, "key").select("id_key", "text_key", "item").distinct()
    hits = found.select(*own, F.explode("hits").alias("key")).join(item_parts, "key")
    exact = (hits.join(candidates, ["id_key", "text_key", "item"])
             .groupBy(*own, "item", "n").agg(F.count_distinct("key").alias("shared")).where(F.col("shared") >= F.lit(threshold) * F.col("n") - 1e-9))
    return exact.join(items.select("item", "item_id"), "item").select(
        *own, "item_id", "shared", F.col("n").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no test item, with all their columns. Null and empty texts stay."""
    bad = staged(contaminated(docs, items, threshold).select("id_key", "text_key").distinct(), "contaminated")
    return looked_up(packed(docs), bad, ["id_key", "text_key"], "left_anti").select("doc.*")
