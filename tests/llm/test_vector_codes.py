"""Vector codes against a restatement with plain integers, and their edge cases."""
import hashlib
import math
import random

import pytest

from tideline.llm import queries, vector_codes


def restated(rows, parts=8, entries=16, rounds=6, factor=4096):
    """(id, label, vector) -> ({row: (code, error)}, books), one part at a time in plain Python."""
    held = [(i, lab, [max(-vector_codes.BOUND, min(vector_codes.BOUND, math.floor(x * factor) if abs(x) < 1e300 else int(x) * factor)) for x in v]) for i, lab, v in rows]
    first = sorted(held, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    step = len(first[0][2]) // parts
    cut = lambda v, p: v[p * step:(p + 1) * step]
    books = [[list(cut(v, p)) for _, _, v in first] for p in range(parts)]

    def choose(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, _, v in held:
                own[choose(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*o)] if o else e for o, e in zip(own, books[p])]
    out = []
    for i, _, v in held:
        found = [choose(v, p) for p in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), min(sum(d for d, _ in found), (1 << 63) - 1)))
    return out, books


def built(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got, book = vector_codes.compress(table)
    return vector_codes.with_label_error(got), book


@pytest.mark.parametrize("kind", ["plain", "ties", "huge", "few"])
def test_equal_to_plain_integers(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_codes, "BLOCK", 37)
    r = random.Random(kind)
    scale = {"plain": 0.2, "ties": 1, "huge": 1e13, "few": 0.2}[kind]
    one = (lambda: float(r.randint(-1, 1))) if kind == "ties" else (lambda: r.gauss(0, scale))
    rows = [(k // 2 if kind == "ties" else 1000 - k, None if k % 5 == 0 else k % 3, [one() for _ in range(16)]) for k in range(9 if kind == "few" else 150)]
    rows += [(None, 1, [one() for _ in range(16)])]
    got, book = built(spark, rows)
    want, books = restated(rows)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = got.collect()
    assert book == books
    assert sorted(((g.vec_id, g.code, g.error) for g in got), key=key) == sorted(want, key=key)
    errors = {}
    for (_, lab, _), (_, _, error) in zip(rows, want, strict=True):
        errors[lab] = errors.get(lab, 0) + error
    assert {g.label: g.label_error for g in got} == {"-" if k is None else f"+{k}": min(v, (1 << 63) - 1) for k, v in errors.items()}
    flat = ",".join(str(x) for p in books for e in p for x in e)
    assert vector_codes.digest(book) == hashlib.sha256(flat.encode()).hexdigest()


def test_decoded_vectors_are_as_far_as_said(spark):
    r = random.Random(8)
    rows = [(k, 0, [r.gauss(0, 0.2) for _ in range(24)]) for k in range(80)]
    got, book = built(spark, rows)
    for g in got.collect():
        v = [math.floor(x * 4096) for x in rows[g.vec_id][2]]
        assert sum((a - b) ** 2 for a, b in zip(v, vector_codes.decoded(g.code, book))) == g.error


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, None), (2, 1, [nan] * 8), (3, 1, [None] * 8), (4, 1, [inf] * 8), (5, 1, [0.5] * 8), (5, 1, [0.5] * 8), (6, None, [0.25] * 7), (7, 2, [])]
    table = spark.createDataFrame([(*x, "clash", 9) for x in rows], "vec_id long, label int, embedding array<double>, code string, n int")
    got, book = vector_codes.compress(table)
    got = {(g.vec_id, g.code, g.error, g.label_error) for g in vector_codes.with_label_error(got).collect()}
    assert got == {(5, "00" * 8, 0, 0), (6, None, None, None), (7, None, None, None)} and len(book[0]) == 2
    empty, none = vector_codes.compress(table.limit(0))
    assert none == [] and vector_codes.with_label_error(empty).count() == 0
    assert vector_codes.with_label_error(vector_codes.compress(table.where("vec_id < 5"))[0]).count() == 0
    no_parts, book = vector_codes.compress(table.where("vec_id = 7"))
    assert [(g.code, g.error) for g in no_parts.collect()] == [("00" * 8, 0)]


def test_query_is_whole(spark):
    assert queries.op13_vector_codes(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
