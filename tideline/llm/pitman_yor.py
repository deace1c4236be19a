"""LM scoring: a hierarchical Pitman-Yor model seated by Gibbs sampling (operator 2).

A token's context is the word before it, whichever that is; before the first word of a text it is END.
Every word of the training texts is the context of a restaurant, so these grow with the corpus. The
tables of all of them are the customers of one parent restaurant over words, whose base is uniform over
the V training words and one unknown word.

A word follows a context as often as the word itself occurs, so a context has as many customers as its
word has occurrences. A pair of words that occurs once has one table for good. What is seated are the
pairs that occur more often (a table of pairs) and the parent's dishes (a table of words). Tables of a
context, and customers of a dish, are the occurrences of the word less the customers who share a table
with others, summed over its pairs.

Given these sums, pairs are independent, so a pass seats all of them in parallel with the sums that the
pass before it left. In a sweep, a share of the customers of every dish gets up, and each sits down
again at a table in proportion to its size less the discount, or at a new one in proportion to strength
plus discount times tables, times the parent's probability of the dish. After burn-in, each pass adds
one sample of the predictive probabilities; scores use their average.

All training texts are counted. Words have long keys: the FREQUENT most frequent ones their place in
the list, all others a 63-bit hash (chance of any collision among 10 million words: 5e-6). What a pair
needs to know of frequent words is broadcast in arrays of fixed size; all other words meet their rows in
a join, with the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import arrow_rows, batches_of, lowered_words, staged

FREQUENT = 1 << 15
#: Passes that seat (the first one burns in), sweeps of each, share of customers moved in a sweep.
PASSES, SWEEPS, MOVED = 3, 2, 0.25
STRENGTH = 1.0
#: Texts that reach Python at a time; rows of pairs that leave it.
TEXTS_AT_ONCE, PAIRS_AT_ONCE = 100, 1 << 16
#: Distinct words a task holds before it sends their counts on; words in a chunk of counts; counts put in order at once.
HELD, CHUNK, MERGED = 50_000, 5_000, 1 << 18
#: Pairs with frequent words that a task holds; occurrences of a word that are counted in one place.
SETTLED, WHOLE = 1 << 21, 1 << 20
END = b""
ENTRY = np.dtype([("ctx", "<i8"), ("n", "<u4")])
EXTRA = np.dtype([("ctx", "<i8"), ("p", "<f4")])
SIGN = -1 << 63
NEAR = pa.list_(pa.struct([("context", pa.int32()), ("word", pa.int32())]))
FAR = pa.list_(pa.struct([("context", pa.int64()), ("word", pa.int64())]))


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def tokens(text: bytes | None) -> list[bytes]:
    words = lowered_words(text)
    words.append(END)
    return words


class Vocabulary:
    """Keys of words: a frequent word's place in the list, any other word's hash with the sign set."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        self.start = self.number.get(END, word_key(END) | SIGN)

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the tokens of a text, and their contexts: the key of the token before each, END's before the first."""
        keys = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(keys < 0).tolist():
            keys[i] = word_key(words[i]) | SIGN
        return keys, np.concatenate([[self.start], keys[:-1]])


def _word_counts(batches):
    """Counts of all words of a task, sent on whenever it holds too many distinct ones."""
    counts: Counter[bytes] = Counter()

    def counted():
        rows = pa.record_batch({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})
        counts.clear()
        return rows

    for (text,) in arrow_rows(batches):
        counts.update(tokens(text))
        if len(counts) > HELD:
            yield counted()
    yield counted()


def frequent_words(training: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """The most frequent words and their exact counts, ties by word: the same ones however the texts are dealt out."""
    rows = (training.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "word").limit(most).collect())
    return {bytes(r["word"]): r["n"] for r in rows}


def _ragged(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary array whose items are the bytes of consecutive runs of `values`."""
    offsets = np.concatenate([[0], np.cumsum(sizes * values.dtype.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())])


def _grouped_counts(word: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sum by (word, context): words, contexts per word, contexts, counts, ordered by both."""
    order = np.lexsort((ctx, word))
    word, ctx, n = word[order], ctx[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (ctx[1:] != ctx[:-1])])) if len(word) else np.zeros(0, np.int64)
    n = np.add.reduceat(n, new) if len(new) else n
    words, sizes = np.unique(word[new], return_counts=True)
    return words, sizes, ctx[new], n


def _count(shared):
    def run(batches):
        words = shared.value
        vocabulary, keys = Vocabulary(words), np.array([word_key(w) for w in words] or [0], np.int64)
        rare: Counter[tuple[bytes, int]] = Counter()
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def rows(word, sizes, ctx, n):
            entries = np.zeros(len(n), ENTRY)
            entries["ctx"], entries["n"] = ctx, n
            return pa.record_batch({"word": pa.array(word, pa.int64()), "counts": _ragged(entries, sizes)})

        def others():
            ints = lambda values: np.fromiter(values, np.int64, len(rare))
            batch = rows(*_grouped_counts(ints(word_key(w) for w, _ in rare), ints(c for _, c in rare), ints(rare.values())))
            rare.clear()
            return batch

        def frequent():
            """Counts of the frequent words, a slice of them at a time."""
            number, sizes, ctx, n = _grouped_counts(*map(np.concatenate, zip(*waiting)))
            waiting.clear()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for at in range(0, len(number), CHUNK):
                to = min(at + CHUNK, len(number))
                yield rows(keys[number[at:to]], sizes[at:to], ctx[ends[at]:ends[to]], n[ends[at]:ends[to]])

        for (text,) in arrow_rows(batches):
            own = tokens(text)
            ids, ctx = vocabulary.read(own)
            known = ids >= 0
            waiting.append((ids[known], ctx[known], np.ones(known.sum(), np.int64)))
            held += len(waiting[-1][0])
            if held > SETTLED:
                number, sizes, of, n = _grouped_counts(*map(np.concatenate, zip(*waiting)))
                waiting[:] = [(np.repeat(number, sizes), of, n)]
                held = len(n)
                if held > SETTLED // 2:  # the texts' pairs differ, so holding them any longer joins few
                    yield from frequent()
                    held = 0
            at = np.flatnonzero(~known)
            rare.update(zip((own[i] for i in at.tolist()), ctx[at].tolist()))
            if len(rare) > HELD:
                yield others()
        yield others()
        if waiting:
            yield from frequent()

    return run


def _counted_in_parts(shared):
    """Counts of a task; those of a very frequent word in parts by context, so that no group holds all of them."""
    def run(batches):
        words, parts = shared.value

        class Words:
            value = words

        for batch in _count(Words)(batches):
            word, counts, part = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [0] * batch.num_rows
            for at in [i for i, w in enumerate(word) if w in parts]:
                entries = np.frombuffer(counts[at], ENTRY)
                of = entries["ctx"] % parts[word[at]]
                counts[at] = entries[of == 0].tobytes()
                for p in range(1, parts[word[at]]):
                    word.append(word[at])
                    part.append(p)
                    counts.append(entries[of == p].tobytes())
            yield pa.record_batch({"word": pa.array(word, pa.int64()), "part": pa.array(part, pa.int32()), "counts": pa.array(counts, pa.binary())})

    return run


class Chunk:
    """Counts of some words: n of each of their contexts, `sizes` contexts a word."""

    def __init__(self, words, sizes, ctx, n):
        self.words, self.sizes, self.ctx, self.n = words, sizes, ctx, n


def _reseated(of: np.ndarray, stay: np.ndarray, customers: np.ndarray, fresh: np.ndarray, discount: float, random) -> tuple[np.ndarray, np.ndarray]:
    """Seat each dish's missing customers next to those who stayed; returns the tables' dishes and sizes."""
    order = np.argsort(of, kind="stable")
    of, stay = of[order], stay[order]
    # where more stay than there are customers now, the last of them leave
    before = np.cumsum(stay) - stay
    first = np.searchsorted(of, np.arange(len(customers)))
    start = before[np.minimum(first, len(before) - 1)] if len(before) else np.zeros(len(customers), np.int64)
    room = customers[of] - (before - start[of])
    stay = np.clip(stay, 0, np.maximum(room, 0))
    of, stay = of[stay > 0], stay[stay > 0]
    missing = customers - np.bincount(of, stay, len(customers)).astype(np.int64)
    empty = np.flatnonzero((missing > 0) & (np.bincount(of, minlength=len(customers)) == 0))
    of, stay = np.concatenate([of, empty]), np.concatenate([stay, np.ones(len(empty), np.int64)])
    missing[empty] -= 1
    order = np.argsort(of, kind="stable")
    of, stay = of[order], stay[order].copy()
    weight = stay - discount
    upto = np.cumsum(weight)
    sitting = np.bincount(of, weight, len(customers))
    base = np.cumsum(sitting) - sitting
    opened = np.zeros(len(customers), np.int64)
    many = np.flatnonzero(missing > 100_000)
    for g in many.tolist():
        lo, hi = np.searchsorted(of, [g, g + 1])
        shares = np.append(weight[lo:hi], fresh[g])
        drawn = random.multinomial(missing[g], shares / shares.sum())
        stay[lo:hi] += drawn[:-1]
        opened[g] = drawn[-1]
    missing[many] = 0
    who = np.repeat(np.arange(len(customers)), missing)
    at = random.random(len(who)) * (sitting + fresh)[who]
    joins = at < sitting[who]
    table = np.minimum(np.searchsorted(upto, (base[who] + at)[joins], side="right"), max(0, len(of) - 1))
    stay += np.bincount(table, minlength=len(of)).astype(np.int64)
    opened += np.bincount(who[~joins], minlength=len(customers))
    more = np.repeat(np.arange(len(customers)), opened)
    return np.concatenate([of, more]), np.concatenate([stay, np.ones(len(more), np.int64)])


def _merged(batches) -> Iterator[Chunk]:
    """Chunks of whole words from count rows that are ordered by word.

    Batches are small, so they are gathered and put in order together, MERGED counts at a time.
    """
    held: list[tuple] = []

    def chunks(last: bool):
        words, sizes, ctx, n = _grouped_counts(*(np.concatenate(x) for x in zip(*held)))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        done = len(words) if last else (len(words) - 1) // CHUNK * CHUNK  # rows of the last word may follow
        for at in range(0, done, CHUNK):
            to = min(at + CHUNK, done)
            yield Chunk(words[at:to], sizes[at:to], ctx[ends[at]:ends[to]], n[ends[at]:ends[to]])
        held[:] = [(np.repeat(words[done:], sizes[done:]), ctx[ends[done]:], n[ends[done]:])]

    waiting = 0
    for batch in batches:
        word = batch.column(0).to_numpy(zero_copy_only=False)
        blobs = batch.column(1).to_pylist()
        entries = np.frombuffer(b"".join(blobs), ENTRY)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // ENTRY.itemsize
        held.append((np.repeat(word, sizes), entries["ctx"].astype(np.int64), entries["n"].astype(np.int64)))
        waiting += len(entries)
        if waiting >= MERGED:
            yield from chunks(last=False)
            waiting = 0
    if any(len(word) for word, _, _ in held):
        yield from chunks(last=True)


def _pairs(shared):
    """Rows (context, word, n) of chunks of counts, both words by their keys."""
    def run(batches):
        keys = np.array([word_key(w) for w in shared.value], np.int64)
        order = np.argsort(keys)
        for chunk in _merged(batches):
            at = np.searchsorted(keys, chunk.words, sorter=order)
            at = order[np.minimum(at, len(keys) - 1)]
            word = np.repeat(np.where(keys[at] == chunk.words, at, chunk.words | SIGN), chunk.sizes)
            for lo in range(0, len(word), PAIRS_AT_ONCE):
                rows = slice(lo, lo + PAIRS_AT_ONCE)
                yield pa.record_batch({"context": pa.array(chunk.ctx[rows]), "word": pa.array(word[rows]), "n": pa.array(chunk.n[rows])})

    return run


class Restaurants:
    """What all words share: the discounts and the parent's totals that a pass left."""

    def __init__(self, once: int, twice: int, words: DataFrame):
        many = lambda k: F.count_if(F.col("customers") == k)
        tokens, types, tables, customers, ones, twos = (x or 0 for x in words.agg(
            F.sum("n"), F.count("*"), F.sum(F.size("roots")), F.sum("customers"), many(1), many(2)).first())
        self.tokens, self.words = tokens, types
        self.discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
        self.root_discount = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
        self.root_total = customers + STRENGTH
        self.root_new = (STRENGTH + self.root_discount * tables) / (types + 1)
        self.unknown = self.root_new / self.root_total

    def backoff(self, n, tables):
        """What a context with n customers at so many tables hands to the parent; columns or arrays."""
        return (tables * self.discount + STRENGTH) / (n + STRENGTH)

    def parent(self, customers, tables):
        """The parent's probability of a dish; columns or arrays."""
        return (customers - tables * self.root_discount + self.root_new) / self.root_total


def _seated(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Dishes and sizes of tables, from one list of sizes a dish."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)


def _lists(of: np.ndarray, sizes: np.ndarray, dishes: int) -> pa.ListArray:
    order = np.argsort(of, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=dishes))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(sizes[order], pa.int64()))


def _swept(lists: pa.ListArray, customers: np.ndarray, fresh: np.ndarray, discount: float, random) -> pa.ListArray:
    of, sizes = _seated(lists)
    for _ in range(SWEEPS):
        of, sizes = _reseated(of, sizes - random.binomial(sizes, MOVED), customers, fresh, discount, random)
    return _lists(of, sizes, len(customers))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _either(key: np.ndarray, joined: pa.Array, listed: np.ndarray, otherwise: float) -> np.ndarray:
    """Values from the list where it has the key, from the joined column elsewhere, or else `otherwise`."""
    values = _numbers(joined.fill_null(otherwise))
    here = (key >= 0) & (key < len(listed))
    values = values.astype(np.result_type(values, listed))
    values[here] = listed[key[here]]
    return values


def _met(far: DataFrame, contexts: DataFrame, words: DataFrame, listed: int) -> DataFrame:
    """Rows with the columns that `contexts` and `words` have on their context and word, by word.

    The first `listed` words are broadcast by number, so rows look for the others only; where a row looks
    for nothing, it is dealt out by its other word.
    """
    for side, other, table in (("context", "word", contexts), ("word", "context", words)):
        rare = lambda c: (F.col(c) < 0) | (F.col(c) >= listed)
        table = table.where(rare("word")).select(F.col("word").alias("key"), *(F.col(c).alias(f"{side}_{c}") for c in table.columns if c != "word"))
        key = F.when(rare(side), F.col(side)).otherwise(F.lit(1 << 40) + F.pmod(other, F.lit(1 << 20)))
        far = far.withColumn("key", key).join(table, "key", "left").drop("key")
    return far


def _seat(shared, number: int, sample: bool):
    """Pairs with their tables of the next pass; own: what tables gave so far, summed over samples."""
    def run(batches):
        now, listed = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns))
            context, word, n = (_numbers(column[c]) for c in ("context", "word", "n"))
            found = {c: _either(context if c.startswith("context") else word, column[c], listed[c.split("_")[1]], 0)
                     for c in ("context_n", "context_tables", "word_customers", "word_dishes")}
            random = np.random.default_rng([number, int(context[0]) & 0xFFFFFFFF, int(word[0]) & 0xFFFFFFFF])
            own = _numbers(column["own"])
            if sample:
                own = own + np.maximum(0, n - now.discount * _numbers(column["tables"].value_lengths()))
            fresh = (STRENGTH + now.discount * found["context_tables"]) * now.parent(found["word_customers"], found["word_dishes"])
            yield pa.record_batch({"context": column["context"], "word": column["word"], "n": column["n"],
                                   "tables": _swept(column["tables"], n, fresh, now.discount, random), "own": pa.array(own, pa.float64())})
    return run


def _seat_parent(number: int, now: Restaurants):
    """Words with the parent's tables for the customers of now."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            customers = _numbers(batch.column("customers"))
            random = np.random.default_rng([number, int(batch.column("word")[0].as_py()) & 0xFFFFFFFF])
            roots = _swept(batch.column("roots"), customers, np.full(len(customers), now.root_new), now.root_discount, random)
            at = batch.schema.get_field_index("roots")
            yield pa.record_batch([roots if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
    return run


def _shared_tables(pairs: DataFrame) -> DataFrame:
    """Customers who sit with others, beyond one a table, by word: as dish in all contexts, and as context of all dishes."""
    more, none = F.col("n") - F.size("tables"), F.lit(0).cast("long")
    side = lambda key, *n: F.struct(F.col(key).alias("key"), *(x.alias(c) for x, c in zip(n, ("as_word", "as_context"))))
    sides = F.array(side("word", more, none), side("context", none, more))
    return pairs.select(F.inline(sides)).groupBy("key").agg(F.sum("as_word").alias("as_word"), F.sum("as_context").alias("as_context"))


def _listed(words: DataFrame, size: int, columns: list[str], empty: float = 0) -> dict[str, np.ndarray]:
    """Columns of the first `size` words as arrays by number."""
    rows = words.where((F.col("word") >= 0) & (F.col("word") < size)).select("word", *columns).toPandas()
    out = {}
    for c in columns:
        out[c] = np.full(size, empty, rows[c].to_numpy().dtype if len(rows) else np.float64)
        out[c][rows["word"].to_numpy(np.int64)] = rows[c].to_numpy()
    return out


class Model:
    """table: n, backoffs and parent's probabilities by word; pairs: what tables give, times customers; vocabulary: the words that are broadcast."""

    def __init__(self, table: DataFrame, pairs: DataFrame, vocabulary: list[bytes], samples: list[Restaurants]):
        self.table, self.pairs, self.vocabulary, self.numbered = table, pairs, vocabulary, vocabulary
        self.tokens, self.types, self.samples = samples[-1].tokens, samples[-1].words, len(samples)
        self.unknown = np.array([s.unknown for s in samples])

    @property
    def backoffs(self) -> np.ndarray:
        """Backoffs of the vocabulary's words as contexts, a row a sample."""
        names = [f"backoff_{i}" for i in range(self.samples)]
        return np.array([x for _, x in sorted(_listed(self.table, len(self.vocabulary), names).items())])

    @property
    def words(self) -> DataFrame:
        """The model by word: n, the parent's probabilities (roots), and what the tables of each context give (extra)."""
        shares = (self.pairs.join(self.table.select(F.col("word").alias("context"), F.col("n").alias("customers")), "context")
                  .groupBy("word").agg(F.collect_list(F.struct("context", (F.col("own") / (F.col("customers") + STRENGTH)).alias("p"))).alias("extra")))
        parents = F.array(*(f"parent_{i}" for i in range(self.samples))).alias("roots")

        def packed(batches):
            for word, n, roots, extra in arrow_rows(batches):
                extra = np.array([(e["context"], e["p"]) for e in extra or []], EXTRA)
                yield pa.record_batch({"word": [word], "n": [n], "roots": [np.array(roots, np.float32).tobytes()], "extra": [extra.tobytes()]})

        return self.table.select("word", "n", parents).join(shares, "word", "left").mapInArrow(packed, "word long, n long, roots binary, extra binary")


def learn(training: DataFrame, frequent: int = FREQUENT) -> Model:
    """Learn from a table with one column `text`; null counts as empty. No rows: every token has probability 1."""
    spark, training = training.sparkSession, training.select(F.col("text").cast("binary").alias("text"))
    with batches_of(spark, TEXTS_AT_ONCE):
        counts = frequent_words(training, frequent)
        parts = {word_key(w): 1 + n // WHOLE for w, n in counts.items() if n >= WHOLE}
        vocabulary = list(counts)
        counted = training.mapInArrow(_counted_in_parts(spark.sparkContext.broadcast((vocabulary, parts))), "word long, part int, counts binary")
        pairs = staged(counted.repartition("word", "part").sortWithinPartitions("word").select("word", "counts")
                       .mapInArrow(_pairs(spark.sparkContext.broadcast(vocabulary)), "context long, word long, n long"), "pairs")
    return _learned(spark, pairs, vocabulary)


def _learned(spark, pairs: DataFrame, vocabulary: list[bytes]) -> Model:
    once, twice = pairs.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    state = pairs.where("n > 1").select("context", "word", "n", F.array("n").alias("tables"), F.lit(0.0).alias("own"))
    words = pairs.groupBy("word").agg(F.sum("n").alias("n")).withColumn("seats", F.array().cast("array<struct<tables: long, customers: long, dishes: long>>"))
    samples: list[Restaurants] = []
    for k in range(PASSES + 1):
        less = lambda c: F.col("n") - F.coalesce(F.col(c), F.lit(0))
        words = words.join(_shared_tables(state).withColumnRenamed("key", "word"), "word", "left").withColumn("customers", less("as_word"))
        words = words.withColumn("tables", less("as_context")).drop("as_word", "as_context")
        if k:
            words = words.mapInArrow(_seat_parent(k, now), words.schema)  # noqa: F821
        else:
            words = words.withColumn("roots", F.array("customers"))
        dishes = F.size("roots").cast("long").alias("dishes")
        words = staged(words.withColumn("seats", F.concat("seats", F.array(F.struct("tables", "customers", dishes)))), f"words-{k}")
        now = Restaurants(once, twice, words)
        if k:
            samples.append(now)
        present = words.select("word", "n", "tables", "customers", dishes)
        words = words.drop("tables", "customers")
        if k < PASSES:
            shared = spark.sparkContext.broadcast((now, _listed(present, len(vocabulary), ["n", "tables", "customers", "dishes"])))
            near = (F.col("context") >= 0) & (F.col("word") >= 0)
            met = _met(state.where(~near), present.select("word", "n", "tables"), present.select("word", "customers", "dishes"), len(vocabulary))
            schema = state.schema
            state = state.where(near).select("*", *(F.lit(None).cast("long").alias(c) for c in met.columns if c not in state.columns)).unionByName(met)
            state = staged(state.mapInArrow(_seat(shared, k, k > 0), schema), f"state-{k}")
    last = F.greatest(F.lit(0.0), F.col("n") - F.size("tables") * now.discount)
    own = state.select("context", "word", ((F.col("own") + last) / len(samples)).alias("own"))
    own = own.union(pairs.where("n = 1").select("context", "word", F.lit(1 - now.discount)))
    seat = lambda i, c: F.col("seats")[i + 1][c]
    table = words.select("word", "n", *(s.backoff(F.col("n"), seat(i, "tables")).alias(f"backoff_{i}") for i, s in enumerate(samples)),
                         *(s.parent(seat(i, "customers"), seat(i, "dishes")).alias(f"parent_{i}") for i, s in enumerate(samples)))
    return Model(table, own, vocabulary, samples)


def _probabilities(roots: np.ndarray, ctx: np.ndarray, own: np.ndarray, backoffs: np.ndarray) -> np.ndarray:
    """Average over samples: what the context's tables give plus what it hands to the parent."""
    return own + (roots * backoffs[:, ctx].T).mean(axis=1)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Kept columns with n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Null texts count as empty: one token, the end. Repeated rows are scored each for itself.
    """
    spark, size = docs.sparkSession, len(model.vocabulary)
    backoffs, parents = ([f"{c}_{i}" for i in range(model.samples)] for c in ("backoff", "parent"))
    listed = _listed(model.table, size, ["n", *backoffs, *parents])
    norm, unknown = model.tokens + model.types + 1, model.unknown
    shared = spark.sparkContext.broadcast((model.numbered, np.log10((listed["n"] + 1) / norm)))
    values = spark.sparkContext.broadcast(listed)
    binary = docs.select(*keep, F.col("text").cast("binary").alias("text"))

    def lists(kind, found):
        ends = np.cumsum([0, *(len(word) for _, word in found)]).astype(np.int32)
        met = [pa.array(np.concatenate(x), t.type) for x, t in zip(zip(*found), kind.value_type)]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(met, ["context", "word"]))

    def first(batches):
        words, base = shared.value
        vocabulary = Vocabulary(words)
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1):
                own = tokens(text.as_py())
                word, ctx = vocabulary.read(own)
                known = (word >= 0) & (word < size)
                near = known & (ctx >= 0) & (ctx < size)
                found.append((len(own), int(known.sum()), float(base[word[known]].sum()), (ctx[near], word[near]), (ctx[~near], word[~near])))
            if not found:
                continue
            *columns, near, far = zip(*found)
            more = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))]
            yield pa.record_batch([*batch.columns[:-1], *more, lists(NEAR, near), lists(FAR, far)],
                                  names=[*batch.schema.names[:-1], "n_tokens", "n_known", "base", "near", "far"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    with batches_of(spark, TEXTS_AT_ONCE):
        rows = staged(binary.mapInArrow(first, f"{kinds}, n_tokens long, n_known long, base double, near array<struct<context: int, word: int>>, far array<struct<context: long, word: long>>")
                      .withColumn("row", F.monotonically_increasing_id()), "scored")

    def told(row, rare, n, own, customers, back, roots):
        """Sums of one text: rare are the words whose base and count are not in `base` and `n_known` yet."""
        logs = np.log10(_probabilities(roots, np.arange(len(own)), own / (customers + STRENGTH), back))
        return pa.record_batch({"row": row, "known": pa.array((rare & (n > 0)).astype(np.int64)),
                                "base": pa.array(np.where(rare, np.log10((n + 1) / norm), 0.0)), "own": pa.array(logs)})

    def near_sums(batches):
        listed = values.value
        n, back, roots = listed["n"], np.array([listed[c] for c in backoffs]), np.array([listed[c] for c in parents]).T
        for row, pair, own in (batch.columns for batch in batches):
            context, word = np.divmod(_numbers(pair), size)
            yield told(row, np.zeros(len(row), bool), n[word], _numbers(own.fill_null(0)), n[context], back[:, context], roots[word])

    def far_sums(batches):
        listed = values.value
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            context, word = _numbers(column["context"]), _numbers(column["word"])
            n = _either(word, column["word_n"], listed["n"], 0)
            back = np.array([_either(context, column[f"context_{c}"], listed[c], 1) for c in backoffs])
            roots = np.array([_either(word, column[f"word_{c}"], listed[c], unknown[i]) for i, c in enumerate(parents)]).T
            customers = _either(context, column["context_n"], listed["n"], 0)
            yield told(column["row"], (word < 0) | (word >= size), n, _numbers(column["own"].fill_null(0)), customers, back, roots)

    # two listed words meet their pair under one number, which sorts faster than two columns
    pair = (F.col("context").cast("long") * size + F.col("word")).alias("pair")
    both = (F.col("context") >= 0) & (F.col("context") < size) & (F.col("word") >= 0) & (F.col("word") < size)
    near = rows.select("row", F.inline("near")).select("row", pair).join(model.pairs.where(both).select(pair, "own"), "pair", "left").select("row", "pair", "own")
    far = rows.select("row", F.inline("far")).join(model.pairs.where(~both), ["context", "word"], "left")
    far = _met(far, model.table.select("word", "n", *backoffs), model.table.select("word", "n", *parents), size)
    sums = "row long, known long, base double, own double"
    sums = (near.mapInArrow(near_sums, sums).union(far.mapInArrow(far_sums, sums)).groupBy("row")
            .agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("own").alias("score")))
    return rows.join(sums, "row", "left").select(
        *keep, "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"), "score")


def perplexity(score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / n_tokens)
