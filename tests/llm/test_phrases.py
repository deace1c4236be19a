"""Phrases against a plain restatement, the filters' round trips, and edge cases."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tideline.llm import phrases


def restated(rows, least, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        kept = []
        for p, a in often.items():
            if 100 * inside[p] < 80 * a:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out |= {(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)}
    return out


def corpus(seed, n=160):
    r = random.Random(seed)
    lexicon = ["New", "york", "city", "hall", "é", "x\x00y", "Ünï", "the", "of", "a"]
    rows = []
    for k in range(n):
        words = [r.choice(lexicon) if r.random() < 0.8 else f"rare{r.random()}" for _ in range(r.randint(0, 60))]
        if k % 3 == 0:
            words += ["new", "york", "city", "hall"]
        rows.append(("".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in words), r.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (". , \n", "de")] + rows[:5]


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_plain_counts(spark, monkeypatch, small):
    if small:  # every bound is met many times over
        for name, value in {"WORDS": 4, "HELD": 50, "HELD_WORDS": 9, "CHUNK": 64, "SLICE": 40, "AT_ONCE": 3}.items():
            monkeypatch.setattr(phrases, name, value)
    rows = corpus(3, 60 if small else 160)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, rank int, phrase string").repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, least=4, top=40).collect()}
    assert got == restated(rows, 4, 40) and len(got) > 40


def test_tables_without_phrases(spark):
    docs = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(docs, least=2).count() == 0
    assert phrases.collocations(docs.limit(0), least=2).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 16, 19, 31, 32])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_packing_and_filters_lose_nothing(bits, n):
    rng = np.random.default_rng(bits * n)
    words = [rng.integers(0, 1 << bits, 3000).astype(np.uint64) for _ in range(n)]
    packing = phrases.Packing(n, bits)
    left, right = packing.packed(words)
    assert all((a == b).all() for a, b in zip(packing.words(left, right), words, strict=True))
    table = phrases.merged(left, right, rng.integers(1, 400, 3000), packing.half)
    layout = phrases.Filter(packing, 8)
    back = [layout.numbers(*row) for row in layout.rows(*table)]
    assert all((np.concatenate([b[k] for b in back]) == table[k]).all() for k in range(3))
    want = Counter()
    for key, c in zip(zip(left.tolist(), right.tolist()), np.random.default_rng(0).integers(1, 9, 3000).tolist()):
        want[key] += c
    a, b, c = phrases.merged(left, right, np.random.default_rng(0).integers(1, 9, 3000), packing.half)
    assert dict(zip(zip(a.tolist(), b.tolist()), c.tolist())) == want


def test_scores_beyond_64_bits(spark):
    big = 1 << 52
    words = spark.createDataFrame([(1, big + 5), (2, big + 9)], "id long, f long")
    grams = spark.createDataFrame([(1, 2, 0, 0, big)], "w1 long, w2 long, w3 long, w4 long, f long")
    assert phrases.scored(words, grams).first().score == 2_000_000 * big // (2 * big + 14)


def test_long_texts_in_slices():
    text = ("word " * 10 + "x" * 3_000_000 + " end. " + "b,c " * 400_000).encode()
    assert [w for s in phrases.tokens(text) for w in s if w != b"\n"] == re.findall(rb"[^\x20\x09.,;:!?\x0A-\x0D]+", text)
    assert list(phrases.tokens(None)) == []
