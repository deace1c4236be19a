"""SimHash near-dedup over a byte-position inverted index with count filtering (operator 8).

Two 64-bit fingerprints that differ in at most 2 bits agree in at least 6 of their 8 bytes. Postings
of single bytes hold 1/256 of all fingerprints, so tallying over them would be quadratic. The two
differing bytes lie in at most two of the four byte pairs; so the other two pairs agree, and the pair
of documents meets in one of the six postings of (two byte pairs). There the shared positional bytes
are tallied, pairs with at least 6 go on, and the bits are verified.

Postings with over POSTING fingerprints (dense groups of near copies) emit no pairs. Their
fingerprints send the 65 values within one bit instead: two fingerprints share such a value exactly
if they differ in at most 2 bits, so linking each to the smallest one at a value keeps every link's
connection, with 65 rows per fingerprint however large the group is.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Sink, arrow_rows, components, id_key, looked_up, lowered_words, packed, staged, text_key

SHINGLE, SEED, BITS_APART, POSTING = 3, 42, 2, 64
#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 14


def fingerprint(text: bytes | None) -> int:
    """SimHash of a UTF-8 text: majority of each bit over the XXH64 of its 3-word shingles, repeats included."""
    words = lowered_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes + 1) - sizes - 1
    starts, ends = begin[:-SHINGLE + 1].tolist(), (begin + sizes)[SHINGLE - 1:].tolist()
    votes, one = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), BLOCK):
        hashes = b"".join([one(joined[s:e], SEED) for s, e in zip(starts[at:at + BLOCK], ends[at:at + BLOCK])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns (long or string) and fp, the fingerprint as a signed long, of every row."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}
    schema = pa.schema([(c, {"bigint": pa.int64(), "int": pa.int32()}.get(k, pa.string())) for c, k in kinds.items()] + [("fp", pa.int64())])

    def run(batches):
        out = Sink(schema)
        for *own, text in arrow_rows(batches):
            fp = fingerprint(text)
            out.add(*own, fp - (1 << 64) if fp >> 63 else fp)
            if out.full:
                yield out.take()
        yield out.take()

    return docs.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "fp long"]))


def shared_bytes(x: Column) -> Column:
    """Number of zero bytes of a xor: the tally of equal positional bytes."""
    return sum((F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(8))


def _postings(fps: DataFrame) -> DataFrame:
    pairs = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(pairs[i], 16)).bitwiseOR(pairs[j]) for n, (i, j) in enumerate(combinations(range(4), 2))]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect exactly those within 2 bits."""
    postings = staged(_postings(fps), "postings")
    sized = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(postings.join(sized, "key"), "met")
    few = met.where(F.col("n") <= POSTING)
    xor = F.col("a").bitwiseXOR(F.col("b"))
    pairs = (few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where("a < b")
             .where(shared_bytes(xor) >= 8 - BITS_APART).where(F.bit_count(xor) <= BITS_APART).select("a", "b"))
    near = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64))]
    many = met.where(F.col("n") > POSTING).select("fp").distinct()
    around = staged(many.select("fp", F.explode(F.array(*near)).alias("value")), "around")
    first = around.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    dense = around.join(first, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(dense)


def near_duplicates(rows: DataFrame) -> DataFrame:
    """Adds component_id, the smallest doc_id reachable over links, and label, the component's smallest fingerprint, to rows (doc_id, fp, ...).

    Equal fingerprints (all empty texts among them) are one group. Null doc_ids never name a group
    that has another id. `rows` should be a written table: it is read several times.
    """
    groups = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fingerprints")
    comps = staged(components(links(groups.select("fp"))), "components")
    named = groups.join(comps.select(F.col("node").alias("fp"), "label"), "fp")
    names = named.groupBy("label").agg(F.min("low").alias("component_id"))
    linked = named.join(names, "label").select("fp", "component_id", "label")
    alone = groups.join(linked.select("fp"), "fp", "left_anti").where("n > 1").select("fp", F.col("low").alias("component_id"), F.col("fp").alias("label"))
    table = staged(linked.withColumn("in_group", F.lit(True)).union(alone.withColumn("in_group", F.lit(True))), "groups")
    out = looked_up(rows, table, ["fp"])
    return out.withColumns({"component_id": F.when(F.col("in_group"), F.col("component_id")).otherwise(F.col("doc_id")), "label": F.coalesce("label", "fp")}).drop("in_group")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with all its columns: the smallest doc_id stays.

    Ties of doc_id go to the smallest text key; of fully repeated rows one stays. A null doc_id only
    stays where its whole group has none. Null and empty texts are one group.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key(F.col("doc_id")).alias("id"), text_key(F.col("text")).alias("txt"), "text")
    rows = staged(fingerprints(keyed, "doc_id", "id", "txt"), "fp")
    grouped = staged(near_duplicates(rows).select("doc_id", "id", "txt", "component_id", "label"), "grouped")
    # a doc_id may name several groups, and a group may have no id: each is told apart by its smallest fingerprint
    low = grouped.where("doc_id <=> component_id").groupBy("label").agg(F.first("id").alias("id"), F.min("txt").alias("txt"))
    kept = low.select("id", "txt").distinct().withColumn("keep", F.lit(True))
    # most documents are alone: only those that go, and those with repeated rows, are looked up
    keys = grouped.groupBy("id", "txt").agg(F.count("*").alias("copies")).join(kept, ["id", "txt"], "left")
    odd = staged(keys.where("keep is null or copies > 1").select(F.col("id").alias("id_key"), F.col("txt").alias("text_key"), "keep", "copies"), "odd")
    out = looked_up(packed(docs), odd, ["id_key", "text_key"])
    order = Window.partitionBy("id_key", "text_key").orderBy(F.lit(1))
    repeated = out.where("keep and copies > 1").withColumn("n", F.row_number().over(order)).where("n = 1")
    return out.where("copies is null").select("doc.*").union(repeated.select("doc.*"))
