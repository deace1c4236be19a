"""Quality classifier: Bradley-Terry ranking of document pairs (operator 1)."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Labelled rows that the weights are learned from, chosen by hash; and opponents of each good row.
SAMPLE, OPPONENTS, RIDGE = 20_000, 4, 1e-2
FEATURES = 16
_MARKS = re.compile(r"[^\w\s.,;:'\"()\-]")
_DIGITS = re.compile(r"\d")


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; an empty or null one is all zero but the first."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (FEATURES - 1)
    size = len(text)
    upper = sum(1 for w in words if w.isupper() and len(w) > 1) / n
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    marks = len(_MARKS.findall(text))
    single = sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n
    rough = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'") / n
    lines = text.split("\n")
    top = Counter(words).most_common(1)[0][1] / n
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    return [
        0.0, math.log1p(n), upper, sum(map(str.isupper, text)) / size,
        marks / size, math.log1p(marks), single, rough, kinds / n, math.log1p(kinds) / math.log1p(n), pairs / max(1, n - 1),
        len(_DIGITS.findall(text)) / size, len(set(lines)) / len(lines), sum(map(len, words)) / n / 10, top, stops / n]


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc, x): the columns to keep as one struct of fields c0, c1, ..., and the features of the text.

    The struct passes through Python as the Arrow column it came as, so types and names don't matter.
    """
    doc = F.struct(F.lit(0).alias("at"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep))).alias("doc")
    rows = docs.select(doc, "text")
    kinds = StructType([rows.schema["doc"], StructField("x", ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc", "x"])

    return rows.mapInArrow(run, kinds)


@dataclass
class Model:
    """score = 1 / (1 + exp(cut - (x - mean) / scale @ weights))."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float


def fit_pairs(good: np.ndarray, bad: np.ndarray, opponents: int = OPPONENTS, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Logistic loss on the feature differences of (good, bad) pairs, by Newton steps.

    Each row meets `opponents` rows of the other label. The cut is the quantile of the sample's scores
    at the share of bad rows. Without both labels there are no pairs: weights 0, every score 0.5.
    """
    every = np.vstack([good, bad])
    if not len(good) or not len(bad):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    mean, scale = every.mean(axis=0), every.std(axis=0)
    scale[scale < 1e-9] = 1.0
    good, bad, random = (good - mean) / scale, (bad - mean) / scale, np.random.default_rng(seed)
    diffs = np.vstack([np.repeat(good, opponents, axis=0) - bad[random.integers(0, len(bad), len(good) * opponents)],
                       good[random.integers(0, len(good), len(bad) * opponents)] - np.repeat(bad, opponents, axis=0)])
    weights = np.zeros(FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(diffs @ weights, -30, 30)))
        slope = diffs.T @ (1 - p) / len(diffs) - ridge * weights
        curve = (diffs * (p * (1 - p))[:, None]).T @ diffs / len(diffs) + ridge * np.eye(FEATURES)
        step = np.linalg.solve(curve, slope)
        weights += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    ordered = np.sort(np.concatenate([good @ weights, bad @ weights]))
    at = len(bad)
    return Model(mean, scale, weights, float((ordered[at - 1] + ordered[min(at, len(ordered) - 1)]) / 2))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text) and (doc_id, quality 0/1). At most `sample` labelled rows, the first by hash of doc_id.

    Labels with a null doc_id or a quality other than 0 and 1 are left out; so are labels without a
    document. Repeated labels count as often as they occur.
    """
    some = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
            .select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = _featured(chosen, ["quality"]).select(F.col("doc.c0").alias("quality"), "x").orderBy(F.xxhash64("x"), "quality").limit(2 * sample).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, FEATURES)
    good = rows["quality"].to_numpy() == 1
    return fit_pairs(x[good], x[~good])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Replaces column text by score (0 to 1) and predicted (1 if score >= 0.5); all rows, whole texts.

    Other columns of any type stay as they came; an own column score or predicted gives way to the new
    one. Null and empty texts get the score of a text without words, equal texts equal scores, repeated
    rows a row each, and an empty table gives none.
    """
    keep = [c for c in docs.columns if c.lower() not in ("text", "score", "predicted")]
    safe = [float(w) for w in model.weights / model.scale]
    shift = float(model.cut + (model.mean / model.scale) @ model.weights)
    raw = F.aggregate(F.zip_with("x", F.array(*map(F.lit, safe)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - F.lit(shift)
    out = _featured(docs, keep).select("doc", (1 / (1 + F.exp(-raw))).alias("score"))
    return out.select(*(F.col(f"doc.c{i}").alias(c) for i, c in enumerate(keep)), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
