"""Phrase collocation mining with counting quotient filters (operator 12).

Words that are frequent enough get dense ids, so that an n-gram is a packed number of known width. A
Feistel network permutes that number: the permutation can be undone, so the upper bits (the quotient)
and all other bits (the remainder) of the result name the n-gram without loss. A task counts into one
filter: sorted remainders per quotient, each with a counter of one byte, or of nine from 255 on.
Filters of a quotient are merged across tasks as sorted runs. An n-gram is counted only where both of
its shorter grams are frequent; they are looked up in a bitmap over the upper bits of their permuted
numbers, whose rare false hits cost a counter and never a result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import Sink, arrow_rows, batches_of, looked_up, staged

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes when a longer candidate around it has this many per cent of its occurrences.
SHARE = 80
#: Words in a dictionary that is sent to tasks; a larger vocabulary is looked up in several passes.
WORDS = 2_000_000
#: Distinct words, and distinct n-grams, that a task holds before it sends its counts on.
HELD_WORDS, HELD = 400_000, 1 << 21
#: Bytes of text that are cut into words at a time, and ids in a row of the written corpus.
SLICE, CHUNK = 1 << 20, 1 << 19
#: Bits of a bitmap per frequent n-gram, and the most that a bitmap has (64 MB).
BITS_EACH, MOST_BITS = 16, 29
#: Distinct n-grams of a quotient aimed at.
AIM = 500_000
#: Rows that reach Python at a time.
AT_ONCE = 128

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_BREAK = b"\n"
_KEYS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def tokens(text: bytes | None) -> Iterator[list[bytes]]:
    """Lower-cased words of a text with a line feed wherever a piece ends, a bounded slice at a time."""
    text, at = (text or b"").translate(_FOLD), 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            ends = [x for x in (text.find(b" ", end), text.find(_BREAK, end)) if x >= 0]
            end = min(ends, default=len(text))
        yield list(filter(None, text[at:end].replace(_BREAK, b" \n ").split(b" ")))
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words of (lang, text), exact; tasks send sums of bounded size."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])

    def run(batches):
        held, size = defaultdict(Counter), 0

        def sent():
            out = Sink(schema)
            for lang, counts in held.items():
                del counts[_BREAK]
                for word, n in counts.items():
                    out.add(lang, word, n)
                    if out.full:
                        yield out.take()
            yield out.take()

        for lang, text in arrow_rows(batches):
            own = held[lang]
            before = len(own)
            for words in tokens(text):
                own.update(words)
            size += len(own) - before
            if size >= HELD_WORDS:
                yield from sent()
                held.clear()
                size = 0
        yield from sent()

    return docs.mapInArrow(run, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def with_ids(words: DataFrame) -> DataFrame:
    """Adds id, distinct and nearly dense from 1 on; no task numbers more than a share of the words."""
    parts = 1 + words.count() // 10_000
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(parts))
    row = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word")).cast("long")
    return words.withColumn("part", part).withColumn("id", (row - 1) * parts + F.col("part") + 1).drop("part")


def _known(words: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(ids.get, words, repeat(0)), np.int32, len(words))


def encoded(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The corpus as rows (own, ids): `own` starts of n-grams, and their ids with those that follow; 0 is no frequent word.

    `words` is (lang, word, id). Dictionaries of at most WORDS words go to the tasks, one pass each.
    """
    spark = docs.sparkSession
    slices = max(1, -(-words.count() // WORDS))
    docs = docs.withColumn("known", F.lit(None).cast("binary"))
    for s in range(slices):
        ids = defaultdict(dict)
        for batch in words.where(F.col("id") % slices == s).select("lang", "word", "id").toArrow().to_batches():
            for lang, word, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids[lang][word] = own
        sent = spark.sparkContext.broadcast(dict(ids))
        if s < slices - 1:
            docs = staged(docs.mapInArrow(_looked_up_in(sent), "lang string, text binary, known binary"), f"known-{s}")
    return docs.mapInArrow(_corpus(sent), "own int, ids binary")


def _found(sent, lang, text, known) -> Iterator[np.ndarray]:
    ids, at = sent.value.get(lang, {}), 0
    before = None if known is None else np.frombuffer(known, np.int32)
    for words in tokens(text):
        own = _known(words, ids)
        if before is not None:
            own = np.maximum(own, before[at:at + len(own)])
            at += len(own)
        yield own


def _looked_up_in(sent):
    schema = pa.schema([("lang", pa.string()), ("text", pa.binary()), ("known", pa.binary())])

    def run(batches):
        out = Sink(schema, AT_ONCE)
        for lang, text, known in arrow_rows(batches):
            out.add(lang, text, b"".join(x.tobytes() for x in _found(sent, lang, text, known)))
            if out.full:
                yield out.take()
        yield out.take()

    return run


def _corpus(sent):
    schema = pa.schema([("own", pa.int32()), ("ids", pa.binary())])
    gap = np.zeros(LONGEST - 1, np.int32)

    def run(batches):
        out, held, size = Sink(schema, 4), [], 0
        for lang, text, known in arrow_rows(batches):
            for own in (*_found(sent, lang, text, known), gap[:1]):
                held.append(own[(own > 0) | np.append(held[-1][-1:] > 0 if held and len(held[-1]) else True, own[:-1] > 0)])
                size += len(held[-1])
            while size >= CHUNK + len(gap):
                whole = np.concatenate(held)
                out.add(CHUNK, whole[:CHUNK + len(gap)].tobytes())
                held, size = [whole[CHUNK:]], size - CHUNK
                if out.full:
                    yield out.take()
        if size:
            out.add(size, np.concatenate([*held, gap]).tobytes())
        yield out.take()

    return run


def _mixed(x: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(29))) & mask


class Packing:
    """n-grams of word ids below 2^bits as two halves of a permuted number, and back."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits = n, bits
        self.half = bits * (1 if n == 2 else 2)
        self.mask = np.uint64((1 << self.half) - 1)

    def packed(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        w = [x.astype(np.uint64) for x in words]
        if self.n == 2:
            left, right = w
        else:
            b = np.uint64(self.bits)
            left, right = (w[0] << b) | w[1], (w[2] << b) | (w[3] if self.n == 4 else np.uint64(0))
        for key in _KEYS:
            left, right = right, left ^ _mixed(right, key, self.mask)
        return left, right

    def words(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        for key in reversed(_KEYS):
            left, right = right ^ _mixed(left, key, self.mask), left
        if self.n == 2:
            return [left, right]
        b, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        return [left >> b, left & low, right >> b, right & low][:self.n]

    def top(self, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
        """The upper bits of the permuted number."""
        if bits <= self.half:
            return left >> np.uint64(self.half - bits)
        more = bits - self.half
        return (left << np.uint64(more)) | (right >> np.uint64(self.half - more))


def merged(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct numbers and the sums of their counts."""
    if not len(left):
        return left, right, counts
    if 2 * half <= 64:
        order = np.argsort((left << np.uint64(half)) | right, kind="stable") if half < 64 else np.lexsort((right, left))
    else:
        order = np.lexsort((right, left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
    return left[first], right[first], np.add.reduceat(counts[order], first)


def _bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _numbers(data: bytes, width: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(n, width)
    return out.view("<u8").ravel().astype(np.uint64)


class Filter:
    """Layout of counting quotient filters: a quotient's sorted full remainders and counters."""

    def __init__(self, packing: Packing, quotients: int):
        self.packing, self.q = packing, min(quotients, packing.half)
        self.rest = packing.half - self.q
        self.widths = -(-self.rest // 8), -(-packing.half // 8)

    def rows(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """(quotient, n, remainders, counters) of sorted distinct numbers."""
        quotient = self.packing.top(left, right, self.q)
        starts = np.flatnonzero(np.append(True, quotient[1:] != quotient[:-1])) if len(quotient) else []
        for a, e in zip(starts, [*starts[1:], len(quotient)]):
            own, c = left[a:e] & np.uint64((1 << self.rest) - 1), counts[a:e]
            small = np.minimum(c, 255).astype(np.uint8)
            yield int(quotient[a]), int(e - a), _bytes(own, self.widths[0]) + _bytes(right[a:e], self.widths[1]), small.tobytes() + c[small == 255].astype(np.int64).tobytes()

    def numbers(self, quotient: int, n: int, remainders: bytes, counters: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = n * self.widths[0]
        left = _numbers(remainders[:cut], self.widths[0], n) | (np.uint64(quotient) << np.uint64(self.rest))
        counts = np.frombuffer(counters[:n], np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(counters[n:], np.int64)
        return left, _numbers(remainders[cut:], self.widths[1], n), counts


def _counted(layout: Filter, shorter: tuple[Packing, int, object] | None):
    """Filters of the n-grams of the corpus whose two shorter grams may be frequent."""
    schema = pa.schema([("quotient", pa.int32()), ("n", pa.int32()), ("remainders", pa.binary()), ("counters", pa.binary())])
    n, half = layout.packing.n, layout.packing.half

    def starts(own: int, ids: np.ndarray) -> np.ndarray:
        last = own + (0 if shorter is None else 1)  # where grams of the length before may start
        length = n if shorter is None else n - 1
        good = np.ones(last, bool)
        for k in range(length):
            good &= ids[k:k + last] > 0
        at = np.flatnonzero(good)
        if shorter is None:
            return at
        packing, bits, sent = shorter
        top = packing.top(*packing.packed([ids[at + k] for k in range(length)]), bits)
        hit = (sent.value[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8)) & 1
        good[at] = hit.astype(bool)
        return np.flatnonzero(good[:-1] & good[1:])

    def run(batches):
        out, held, size = Sink(schema, 64), [], 0
        table = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def joined():
            return merged(*(np.concatenate([table[k], *(h[k] for h in held)]) for k in range(3)), half)

        for own, ids in arrow_rows(batches):
            ids = np.frombuffer(ids, np.int32)
            at = starts(own, ids)
            left, right = layout.packing.packed([ids[at + k] for k in range(n)])
            held.append((left, right, np.ones(len(at), np.int64)))
            size += len(at)
            if size >= HELD:
                table, held, size = joined(), [], 0
                if len(table[0]) >= HELD:
                    for row in layout.rows(*table):
                        out.add(*row)
                        if out.full:
                            yield out.take()
                    table = tuple(x[:0] for x in table)
        table = joined()
        for row in layout.rows(*table):
            out.add(*row)
            if out.full:
                yield out.take()
        yield out.take()

    return run


def _frequent(layout: Filter, least: int):
    """Merges sorted filters, quotient by quotient, and hands out the n-grams with at least `least` occurrences."""
    schema = pa.schema([*((f"w{k}", pa.int64()) for k in range(1, LONGEST + 1)), ("f", pa.int64())])

    def run(batches):
        now, held, size = None, [], 0

        def joined():
            return merged(*(np.concatenate([h[k] for h in held]) for k in range(3)), layout.packing.half)

        def told():
            left, right, counts = joined()
            often = counts >= least
            words = [w.astype(np.int64) for w in layout.packing.words(left[often], right[often])]
            words += [np.zeros(int(often.sum()), np.int64)] * (LONGEST - len(words))
            return pa.record_batch([pa.array(c) for c in (*words, counts[often])], schema=schema)

        for quotient, n, remainders, counters in arrow_rows(batches):
            if quotient != now and held:
                yield told()
                held, size = [], 0
            now = quotient
            held.append(layout.numbers(quotient, n, remainders, counters))
            size += n
            if size >= HELD and len(held) > 1:
                held, size = [joined()], 0
        if held:
            yield told()

    return run


def _bitmap(grams: DataFrame, packing: Packing) -> tuple[int, np.ndarray]:
    """Bits at the upper bits of the permuted frequent n-grams; as many bits as their counted number asks for, within MOST_BITS."""
    bits = min(MOST_BITS, 2 * packing.half, max(10, (BITS_EACH * grams.count()).bit_length()))
    schema = pa.schema([("at", pa.int64())])

    def run(batches):
        for batch in batches:
            words = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:packing.n]]
            yield pa.record_batch([pa.array(packing.top(*packing.packed(words), bits).astype(np.int64))], schema=schema)

    at = grams.select(*(f"w{k}" for k in range(1, LONGEST + 1))).mapInArrow(run, "at long").select((F.col("at") + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for r in parts:
        own = np.frombuffer(r.bits, np.uint8)
        out[(r.part - 1) * 4096:(r.part - 1) * 4096 + len(own)] = own
    return bits, out


def frequent_grams(corpus: DataFrame, bits: int, tokens_known: int, least: int = LEAST) -> DataFrame:
    """(w1, w2, w3, w4, f): all 2- to 4-grams of a written corpus with at least `least` occurrences; unused words are 0."""
    spark, shorter, out = corpus.sparkSession, None, None
    quotients = min(20, max(8, (tokens_known // AIM).bit_length()))
    for n in range(2, LONGEST + 1):
        layout = Filter(Packing(n, bits), quotients)
        filters = corpus.mapInArrow(_counted(layout, shorter), "quotient int, n int, remainders binary, counters binary")
        found = filters.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(_frequent(layout, least), "w1 long, w2 long, w3 long, w4 long, f long")
        found = staged(found, f"grams-{n}")
        out = found if out is None else out.union(found)
        if n < LONGEST:
            size, bitmap = _bitmap(found, layout.packing)
            shorter = (layout.packing, size, spark.sparkContext.broadcast(bitmap))
    return out


def _key(words: Column) -> Column:
    """A phrase of up to four ids as two numbers."""
    two = lambda a, b: F.shiftleft(F.coalesce(F.get(words, a), F.lit(0).cast("long")), 32).bitwiseOR(F.coalesce(F.get(words, b), F.lit(0).cast("long")))
    return F.struct(two(0, 1).alias("hi"), two(2, 3).alias("lo"))


def scored(words: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, words, a, l, r, score) of the candidates that no longer candidate replaces."""
    grams = grams.select(F.filter(F.array("w1", "w2", "w3", "w4"), lambda x: x > 0).alias("words"), F.col("f").alias("a")).withColumn("key", _key(F.col("words")))
    known = staged(grams.select("key.hi", "key.lo", F.col("a").alias("f")).union(words.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "f")), "known")
    size = F.size("words")
    cuts = grams.select("key", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("key", "words", "a", "k", _key(F.slice("words", F.lit(1), F.col("k"))).alias("x"), _key(F.slice("words", F.col("k") + 1, size - F.col("k"))).alias("y"))
    cuts = looked_up(cuts.withColumns({"hi": F.col("x.hi"), "lo": F.col("x.lo")}), known, ["hi", "lo"], "inner").withColumnRenamed("f", "l").drop("hi", "lo")
    cuts = looked_up(cuts.withColumns({"hi": F.col("y.hi"), "lo": F.col("y.lo")}), known, ["hi", "lo"], "inner").withColumnRenamed("f", "r").drop("hi", "lo")
    score = F.expr("cast(a as decimal(25,0)) * 2000000 div (cast(l as decimal(25,0)) + r)").cast("long")
    best = cuts.select("key", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("key").agg(F.min("cut").alias("cut"), F.first("words").alias("words"), F.first("a").alias("a"))
    longer = grams.where(size > 2).withColumn("spans", F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: _key(F.slice("words", i, m))))))
    around = longer.select(F.explode("spans").alias("key"), "a").groupBy("key").agg(F.max("a").alias("around"))
    kept = best.join(around, "key", "left").where(F.col("around").isNull() | (F.col("around").cast("decimal(25,0)") * 100 < F.col("a").cast("decimal(25,0)") * SHARE))
    return kept.select("key", "words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Reads lang (null: und) and text (null: empty); other columns are not read. Repeated rows count as
    often as they occur. Ties of score go to the larger a, then to the phrase that comes first in
    bytes. A language without candidates, and an empty table, have no rows. A text of any length is
    cut into words slice by slice.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    with batches_of(spark, AT_ONCE):
        counts = staged(word_counts(texts), "words")
        words = staged(with_ids(counts.where(F.col("f") >= least)), "vocabulary")
        highest, known = words.agg(F.coalesce(F.max("id"), F.lit(1)), F.coalesce(F.sum("f"), F.lit(0))).first()
        corpus = staged(encoded(texts, words.select("lang", "word", "id")), "corpus")
        grams = frequent_grams(corpus, int(highest).bit_length(), int(known), least)
        found = staged(scored(words, grams), "scored")
    named = looked_up(found.withColumn("id", F.get("words", F.lit(0))), words.select("id", "lang"), ["id"], "inner").drop("id")
    order = [F.desc("score"), F.desc("a")]
    first = staged(named.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("place"), "first")
    spelt = looked_up(first.select("key", F.posexplode("words").alias("pos", "id")), words.select("id", F.col("word").cast("string").alias("word")), ["id"], "inner")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = staged(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    out = looked_up(first.join(spelt, "key"), totals, ["lang"], "inner")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
