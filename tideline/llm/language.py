"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 5)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Sink, arrow_rows

#: Buckets of hashed n-grams; the matrix is one row of languages per bucket, whatever the input's size.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Characters hashed at a time, so that a very long text takes bounded memory.
SLICE = 1 << 18
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of a text, lower-cased and padded with a space on both sides."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(codes), SLICE):
        part = codes[at:at + SLICE + max(ORDERS) - 1]
        mixed = [part * m for m in MULTIPLIERS]
        for n in ORDERS:
            size = min(len(part) - n + 1, SLICE)
            if size > 0:
                h = mixed[0][:size] + np.uint32(n)
                for k in range(1, n):
                    h = h ^ mixed[k][k:k + size]
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                yield (h >> np.uint32(17)).astype(np.int64)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    """Log-probabilities: weights is (BUCKETS, languages) float32, priors one number per language."""
    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray


def _count(batches):
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + 1, np.int64))
    waiting: dict[str, list[np.ndarray]] = defaultdict(list)
    held: Counter[str] = Counter()

    def settle(lang):
        if waiting[lang]:
            counts[lang][:BUCKETS] += np.bincount(np.concatenate(waiting.pop(lang)), minlength=BUCKETS)
        held[lang] = 0

    for lang, text in arrow_rows(batches):
        counts[lang][BUCKETS] += 1
        for ids in gram_buckets(text):
            waiting[lang].append(ids)
            held[lang] += len(ids)
            if held[lang] > SLICE:
                settle(lang)
    for lang in list(counts):
        settle(lang)
        own = counts[lang]
        at = np.flatnonzero(own)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(own[at], pa.int64())})


def learn(rows: DataFrame) -> Model:
    """Learn from (lang, text). All rows count; each task sends at most BUCKETS counts per language.

    Rows with a null lang or a text without a letter are left out. No rows give a model without languages.
    """
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(F.col("lang").cast("string").alias("lang"), "text")
    sums = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(languages)))
    counts[sums["bucket"].to_numpy(np.int64), np.searchsorted(np.array(languages, dtype=object), sums["lang"].to_numpy()) if languages else []] = sums["n"].to_numpy()
    docs, counts = counts[BUCKETS], counts[:BUCKETS] + SMOOTHING
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32) if languages else counts.astype(np.float32),
                 np.log(docs / docs.sum()) if languages else docs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score (posterior of the predicted language) to every (doc_id, text, ...) row kept.

    The matrix is broadcast; every whole text is scored in slices. `und` with score 0 where the text
    is null, has no letter, or nothing was learned. Ties go to the language first by code point.
    Needs a boolean column letters (see `has_letter`); returns the other columns and the two new ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.priors))
    keep = [c for c in docs.columns if c not in ("text", "letters")]
    schema = pa.schema([(c, {"bigint": pa.int64(), "boolean": pa.bool_()}.get(docs.schema[c].dataType.simpleString(), pa.string())) for c in keep]
                       + [("lang_pred", pa.string()), ("score", pa.float64())])

    def score(batches):
        languages, weights, priors = shared.value
        out = Sink(schema)
        for *own, letters, text in arrow_rows(batches):
            if letters and languages:
                logs = priors.copy()
                for ids in gram_buckets(text):
                    if len(languages) > 16:  # sum each distinct bucket's row once
                        seen, n = np.unique(ids, return_counts=True)
                        logs += n @ weights[seen].astype(np.float64)
                    else:
                        logs += weights[ids].sum(axis=0, dtype=np.float64)
                best = int(np.argmax(logs))
                out.add(*own, languages[best], float(1 / np.exp(logs - logs[best]).sum()))
            else:
                out.add(*own, "und", 0.0)
            if out.full:
                yield out.take()
        yield out.take()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "letters", "text").mapInArrow(score, f"{kinds}{', ' * bool(keep)}lang_pred string, score double")
