"""Substring dedup: MinHash of every window of words, verified and merged word by word (operator 4).

Repeated passages often sit in the middle of a line, so the paragraphs compared here are all windows of
MIN_WORDS words, wherever they start. A window is found by one MinHash value, the smallest hash of its
GRAM-word runs: equal windows have equal minima, so every passage of MIN_WORDS words or more that
occurs twice is found, and neighbouring windows share minima, so there is one in about seven words to
send. A near copy (five-word Jaccard of THRESHOLD) of a few more words always holds an equal window:
one changed word in 45 is all it may have. Equal windows are joined to runs, and runs across edits.

Two reads of the texts keep the shuffles small: the first sends only minima; the second sends the
texts with a window that a filter of fixed size lets through, as 32-bit word hashes. Of equal texts
only the first one's windows are compared.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Sink, arrow_rows, id_key, looked_up, lowered_words, staged, text_key

SHINGLE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99, 2
#: Words of the runs whose hashes are minimised; words that a reported passage has at least.
GRAM, MIN_WORDS = 8, 20
#: Words around the ends of a run in which a tail too short for a window is looked for behind an edit.
AROUND = 32
#: Bits of the filter that is broadcast per counted key, its most bits as a power (64 MB), and those of a slice.
#: Fuller filters let more texts through that repeat nothing; results stay the same.
BITS_EACH, MOST_BITS, SLICE_BITS = 64, 29, 20
#: A place is a document's number and a word of it in one long.
START_BITS = 25
MIX = np.uint64(0x9E3779B97F4A7C15)


def tuned_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of `rows` minima that find a pair of similarity `threshold` with probability `recall`.

    Windows are equal or not, so the search itself needs one band of one minimum.
    """
    return ceil(np.log(1 - recall) / np.log(1 - threshold ** rows))


def word_hashes(words: list[bytes]) -> np.ndarray:
    own: dict[bytes, int] = {}
    one = xxhash.xxh64_intdigest
    return np.fromiter((own[w] if w in own else own.setdefault(w, one(w)) for w in words), np.uint64, len(words)).astype(np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(ids) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = _mixed(out ^ (ids[k:k + len(out)] + MIX))
    return out


def minima(grams: np.ndarray, window: int) -> np.ndarray:
    """The MinHash value of each window of `window` words."""
    size = window - GRAM + 1
    return sliding_window_view(grams, size).min(axis=1) if len(grams) >= size else np.zeros(0, np.uint64)


def window_keys(grams: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows that start at `at`, out of grams that cover all their words."""
    key = np.zeros(len(at), np.uint64)
    for k in sorted({*range(0, window - GRAM + 1, GRAM), window - GRAM}):
        key = _mixed(key ^ grams[at + k])
    return key.view(np.int64)


def _minima(window: int):
    def run(batches):
        held, size = [], 0
        for (text,) in arrow_rows(batches):
            low = minima(gram_hashes(word_hashes(lowered_words(text))), window)
            if len(low):
                new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                # a minimum that stays for longer than its gram can be in the window stands there twice
                twice = np.diff(np.append(new, len(low))) > window - GRAM + 1
                held += [low[new], low[new[twice]]]
                size += len(new)
            if size > 100_000:
                yield pa.record_batch({"key": pa.array(np.concatenate(held).view(np.int64))})
                held, size = [], 0
        if held:
            yield pa.record_batch({"key": pa.array(np.concatenate(held).view(np.int64))})

    return run


def _positions(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    u = keys.view(np.uint64)
    return (u >> np.uint64(64 - size)).astype(np.int64), (u & np.uint64((1 << size) - 1)).astype(np.int64)


def _filter(keys: DataFrame) -> tuple[int, np.ndarray]:
    """Bit set with two bits per key, and the power of its size. It is built in slices by the tasks; its bits reach the driver."""
    size = min(MOST_BITS, max(SLICE_BITS, (BITS_EACH * keys.count()).bit_length()))
    per = 1 << SLICE_BITS
    mask = F.lit((1 << size) - 1)
    at = F.explode(F.array(F.shiftrightunsigned("key", 64 - size), F.col("key").bitwiseAND(mask)))

    def slices(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for number in np.unique(values // per).tolist():
                own = values[values // per == number] % per
                np.bitwise_or.at(found.setdefault(number, np.zeros(per >> 3, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        if found:
            yield pa.record_batch({"slice": pa.array(list(found), pa.int64()), "bits": pa.array([x.tobytes() for x in found.values()], pa.binary())})

    rows = keys.select(at.alias("at")).repartition(F.shiftright("at", SLICE_BITS)).mapInArrow(slices, "slice long, bits binary").collect()
    bits = np.zeros(1 << (size - 6), np.int64)
    for r in rows:
        bits[r["slice"] * (per >> 6):(r["slice"] + 1) * (per >> 6)] = np.frombuffer(bytes(r["bits"]), "<i8")
    return size, bits


def _holds(shared: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    size, bits = shared
    a, b = _positions(keys, size)
    return (bits[a >> 6] >> (a & 63)) & (bits[b >> 6] >> (b & 63)) & 1 == 1


def _candidates(shared, window: int):
    schema = pa.schema([("id_key", pa.string()), ("text_key", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("same", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        out, held = Sink(schema), 0
        for key, text_key_, doc_id, text in arrow_rows(batches):
            ids = word_hashes(lowered_words(text))
            if len(ids) >> START_BITS:
                raise ValueError(f"a text has {len(ids)} words; a place holds {1 << START_BITS}")
            low = minima(gram_hashes(ids), window)
            if len(low) and _holds(shared.value, low).any():
                blob = ids.astype("<u4").tobytes()
                out.add(key, text_key_, doc_id, len(ids), xxhash.xxh64_intdigest(blob) - (1 << 63), blob)
                held += len(ids)
            if held > 500_000:
                yield out.take()
                held = 0
        yield out.take()

    return run


def _windows(shared, window: int):
    def run(batches):
        for number, ids in arrow_rows(batches):
            grams = gram_hashes(np.frombuffer(ids, "<u4"))
            at = np.flatnonzero(_holds(shared.value, minima(grams, window)))
            yield pa.record_batch({"key": pa.array(window_keys(grams, at, window)), "place": pa.array((number << START_BITS) + at)})

    return run


def _jaccard(common: int, own: int, other: int) -> float:
    """Of two stretches of `own` and `other` words with `common` shared five-word runs."""
    return common / max(1, own + other - 2 * (SHINGLE - 1) - common)


def bridged(runs: list[list[int]], threshold: float) -> list[list[int]]:
    """Runs [start, end, source start, source end, common, passage] of one source, joined across edits while Jaccard holds."""
    runs = sorted(runs)
    while True:
        out = runs[:1]
        for start, end, start_, end_, common, key in runs[1:]:
            last = out[-1]
            over = max(0, last[1] - start, last[3] - start_)
            both = last[4] + common - over
            if end > last[1] and end_ > last[3] and common > over and _jaccard(both, end - last[0], end_ - last[2]) >= threshold - 1e-9:
                out[-1] = [last[0], end, last[2], end_, both, min(key, last[5])]
            else:
                out.append([start, end, start_, end_, common, key])
        if len(out) == len(runs):
            return out
        runs = out


def extended(own: list[int], other: list[int], sizes: tuple[int, int, int], threshold: float) -> tuple[int, tuple[int, int, int]]:
    """Words of `own` that go on with the match of sizes (own, other, common), equal or across edits."""
    i = j = reach = 0
    while True:
        found = None
        grams = {tuple(other[k:k + SHINGLE]): k for k in range(len(other) - SHINGLE, j - 1, -1)}
        for k in range(i, len(own) - SHINGLE + 1):
            if found and k - i >= found[0]:
                break
            at = grams.get(tuple(own[k:k + SHINGLE]))
            if at is not None and (found is None or k - i + at - j < found[0]):
                found = k - i + at - j, k, at
        if found is None:
            return reach, sizes
        edit, k, at = found
        n = SHINGLE
        while k + n < len(own) and at + n < len(other) and own[k + n] == other[at + n]:
            n += 1
        more = sizes[0] + k + n - i, sizes[1] + at + n - j, sizes[2] + n - (SHINGLE - 1 if edit else 0)
        if _jaccard(more[2], more[0], more[1]) < threshold - 1e-9:
            return reach, sizes
        i, j, sizes, reach = k + n, at + n, more, k + n


SPAN = pa.schema([(c, pa.int64()) for c in ("number", "start", "end", "source", "source_start", "source_end", "common", "passage")])
SPANS = ", ".join(f"{c} long" for c in SPAN.names)


def _spans(window: int, threshold: float):
    """From places in order, with the first place of the same window: spans and what they repeat.

    A span that is the first of its windows has itself as source.
    """
    mask = (1 << START_BITS) - 1

    def run(batches):
        out, number, last, runs = Sink(SPAN), None, None, []

        def flush():
            by: dict[int, list[list[int]]] = {}
            for place, n, first in runs:
                start, start_ = place & mask, first & mask
                by.setdefault(first >> START_BITS, []).append([start, start + n + window - 1, start_, start_ + n + window - 1, n + window - SHINGLE, first])
            for source, own in by.items():
                plain = own
                if source == number:
                    # the first words of a text that goes on repeating itself stay
                    plain = [r for r in own if r[0] - r[2] >= window]
                    for r in own:
                        if r[0] - r[2] < window:
                            begin = r[0] if r[0] == r[2] else max(r[0], r[2] + window)
                            if begin < r[1]:
                                out.add(number, begin, r[1], source, begin if r[0] == r[2] else r[2], r[3], r[4], r[5])
                for r in bridged(plain, threshold):
                    out.add(number, r[0], r[1], source, *r[2:])

        for batch in batches:
            place, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0])) if len(place) else []
            place, first = place[new], first[new]
            if not len(place):
                continue
            at = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(first) != 1)]))
            sizes = np.diff(np.append(at, len(place)))
            for p, n, f in zip(place[at].tolist(), sizes.tolist(), first[at].tolist()):
                if p >> START_BITS != number:
                    flush()
                    number, runs = p >> START_BITS, []
                if runs and runs[-1][0] + runs[-1][1] == p and runs[-1][2] + runs[-1][1] == f:
                    runs[-1][1] += n
                elif not runs or runs[-1][0] + runs[-1][1] <= p:  # a repeated row at the edge of a batch counts once
                    runs.append([p, n, f])
            if out.full:
                yield out.take()
        flush()
        yield out.take()

    return run


def _around(batches):
    for number, ids, ats in arrow_rows(batches):
        ids = np.frombuffer(ids, "<u4")
        before, behind = [ids[max(0, a - AROUND):a][::-1].tobytes() for a in ats], [ids[a:a + AROUND].tobytes() for a in ats]
        yield pa.record_batch({"number": pa.array([number] * len(ats), pa.int64()), "at": pa.array(ats, pa.int64()), "before": pa.array(before, pa.binary()), "behind": pa.array(behind, pa.binary())})


def _grown(threshold: float):
    def run(batches):
        out = Sink(SPAN)
        for *span, own_left, other_left, own_right, other_right in arrow_rows(batches):
            number, start, end, source, start_, end_, common, key = span
            left, right, other, more = (np.frombuffer(x, "<u4").tolist() for x in (own_left, own_right, other_left, other_right))
            after, sizes = extended(right, more, (end - start, end_ - start_, common), threshold)
            ahead, sizes = extended(left, other, sizes, threshold)
            out.add(number, start - ahead, end + after, source, start_, end_, common, key)
            if out.full:
                yield out.take()
        yield out.take()

    return run


def _passages(min_words: int):
    schema = pa.schema([("number", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("passage", pa.int64()), ("first", pa.int64()), ("removed", pa.bool_())])

    def united(spans):
        out: list[list[int]] = []
        for start, end, key, first in sorted(spans):
            if out and start <= out[-1][1]:
                out[-1][1:] = [max(end, out[-1][1]), min(key, out[-1][2]), min(first, out[-1][3])]
            else:
                out.append([start, end, key, first])
        return out

    def run(batches):
        out = Sink(schema)
        for number, spans in arrow_rows(batches):
            gone = united((s["start"], s["end"], s["passage"], s["source"]) for s in spans if s["repeats"])
            stays, k = [], 0
            for start, end, key, first in united((s["start"], s["end"], s["passage"], s["source"]) for s in spans if not s["repeats"]):
                while k < len(gone) and gone[k][1] <= start:
                    k += 1
                for g in gone[k:]:
                    if g[0] >= end:
                        break
                    stays.append((start, g[0], key, first))
                    start = g[1]
                stays.append((start, end, key, first))
            for removed, some in ((True, gone), (False, stays)):
                for start, end, key, first in some:
                    if end - start >= min_words:
                        out.add(number, start, end - start, key, first, removed)
            if out.full:
                yield out.take()
        yield out.take()

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds number, 0, 1, ... by doc_id (null last) and text key, to distinct (id_key, text_key, doc_id, ...)."""
    ordered = docs.orderBy(F.col("doc_id").isNull(), "doc_id", "text_key").withColumn("row", F.monotonically_increasing_id())
    ordered = staged(ordered, "ordered")
    part = F.shiftright("row", 33)
    before, starts = 0, {}
    for r in sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts[r["part"]], before = before, before + r["n"]
    offset = F.array(*(F.lit(starts.get(k, 0)).cast("long") for k in range(max(starts, default=0) + 1)))
    return ordered.select(*docs.columns, (F.get(offset, part.cast("int")) + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages that repeat: id_key, text_key, doc_id, start, words, passage, first_doc_id, removed.

    Every window of `min_words` ASCII-lowered words (GRAM at least) that occurs twice is found. Its
    first occurrence (smallest doc_id, then text key, then start) stays and all others are removed.
    Removed runs that repeat one document are joined across the words changed between them, and go on
    across an edit into tails that are too short for a window, while the Jaccard of the five-word runs
    of both stretches is `threshold` or more (runs counted by place; tails begin within AROUND words).
    Overlapping and adjacent runs with the same decision make a passage. `start` counts words from 0,
    `passage` numbers the first place of its windows and `first_doc_id` is the smallest doc_id that holds
    one of them first; a text equal to an earlier one is one passage that repeats the first such text. Passages repeated within a document count too; where they overlap, the first
    occurrence stays whole. Null and short texts have no window. Null doc_ids come last; of repeated
    rows one counts. An empty table gives an empty result.
    """
    window = max(GRAM, min_words)
    texts = docs.select(id_key(F.col("doc_id")).alias("id_key"), text_key(F.col("text")).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spark = docs.sparkSession
    twice = staged(texts.select("text").mapInArrow(_minima(window), "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "minima")
    shared = spark.sparkContext.broadcast(_filter(twice))
    found = staged(texts.mapInArrow(_candidates(shared, window), "id_key string, text_key long, doc_id long, size long, same long, ids binary"), "found")
    names = staged(_numbered(found.select("id_key", "text_key", "doc_id", "size", "same").distinct()), "names")
    leads = staged(names.groupBy("same").agg(F.min("number").alias("lead"), F.count("*").alias("n")), "leads")
    equal = staged(names.join(leads, "same").select("id_key", "text_key", "number", "size", "lead", "n"), "equal")
    placed = looked_up(found, equal.where("number = lead").select("id_key", "text_key", "number"), ["id_key", "text_key"], "inner")
    placed = staged(placed.select("number", "ids"), "placed")
    # all of a text that has equals: the first stays, the others repeat it
    zero, place = F.lit(0).cast("long"), F.shiftleft("lead", START_BITS)
    whole = equal.where("n > 1").select("number", zero.alias("start"), F.col("size").alias("end"), F.col("lead").alias("source"), zero.alias("source_start"), F.col("size").alias("source_end"),
                                        (F.col("size") - SHINGLE + 1).alias("common"), place.alias("passage"))

    windows = placed.mapInArrow(_windows(shared, window), "key long, place long")
    firsts = staged(windows.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("key", "first"), "firsts")
    met = looked_up(windows, firsts, ["key"], "inner").select("place", "first")
    spans = staged(met.repartition(F.shiftright("place", START_BITS)).sortWithinPartitions("place").mapInArrow(_spans(window, threshold), SPANS), "spans")

    # a tail under a window adds to 20 words or so; shorter runs cannot carry the edit before it
    long = (F.col("source") != F.col("number")) & (F.col("end") - F.col("start") >= window + SHINGLE)
    ends = spans.where(long)
    asked = F.explode(F.array(*(F.struct(F.col(n).alias("number"), F.col(a).alias("at")) for n, a in (("number", "start"), ("number", "end"), ("source", "source_start"), ("source", "source_end")))))
    asked = ends.select(asked.alias("x")).select("x.*").distinct().groupBy("number").agg(F.collect_list("at").alias("ats"))
    around = placed.select("number", "ids").join(asked, "number").mapInArrow(_around, "number long, at long, before binary, behind binary")
    around = staged(around.dropDuplicates(["number", "at"]), "around")
    for n, a, side, name in (("number", "start", "before", "x0"), ("source", "source_start", "before", "x1"), ("number", "end", "behind", "x2"), ("source", "source_end", "behind", "x3")):
        ends = looked_up(ends, around.select(F.col("number").alias(n), F.col("at").alias(a), F.col(side).alias(name)), [n, a], "inner")
    grown = ends.select(*SPAN.names, "x0", "x1", "x2", "x3").mapInArrow(_grown(threshold), SPANS)

    every = spans.where(~long).union(grown).union(whole)
    repeats = (F.col("source") != F.col("number")) | (F.col("source_start") != F.col("start"))
    by = every.groupBy("number").agg(F.collect_list(F.struct("start", "end", "passage", "source", repeats.alias("repeats"))).alias("spans"))
    rows = staged(by.mapInArrow(_passages(min_words), "number long, start long, words long, passage long, first long, removed boolean"), "passages")
    rows = looked_up(rows, names.select("number", "id_key", "text_key", "doc_id"), ["number"], "inner")
    rows = looked_up(rows, names.select(F.col("number").alias("first"), F.col("doc_id").alias("first_doc_id")), ["first"], "inner")
    return rows.select("id_key", "text_key", "doc_id", "start", "words", "passage", "first_doc_id", "removed")


def without_repeats(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents with the removed passages cut out of their texts; other columns pass through.

    A passage goes with the space after it. Null texts stay null; a text that is all repeated becomes empty.
    """
    gone = repeated_passages(docs, threshold, min_words).where("removed").groupBy("id_key", "text_key").agg(F.collect_list(F.struct("start", "words")).alias("gone"))
    gone = staged(gone.select(F.col("id_key").alias("__id"), F.col("text_key").alias("__text"), F.col("gone").alias("__gone")), "gone")
    keyed = docs.withColumns({"__id": id_key(F.col("doc_id")), "__text": text_key(F.col("text"))})
    joined = looked_up(keyed, gone, ["__id", "__text"])

    @F.pandas_udf("string")
    def cut(text, spans):
        import re

        import pandas as pd

        def one(t, s):
            at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)]
            for r in sorted(s, key=lambda r: -r["start"]):
                t = t[:at[r["start"]][0]] + t[at[r["start"] + r["words"] - 1][1]:]
            return t

        return pd.Series([t if s is None or t is None else one(t, s) for t, s in zip(text, spans)], dtype=object)

    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cut("text", "__gone"))
    return joined.withColumn("text", text).select(*docs.columns)
