"""Near vectors against all pairs in double precision, and edge cases."""
import numpy as np
import pytest

from tideline.llm import near_vectors


def restated(rows):
    """(id, vector) -> sorted (id, n_links, component_id, kept) from all pairs."""
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    top = list(range(len(rows)))
    degree = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.9:
                    degree[i] += 1
                    degree[j] += 1
                    x, y = sorted((top[i], top[j]))
                    top = [x if t == y else t for t in top]
    low = {}
    for (own, _), t in zip(rows, top, strict=True):
        low[t] = min((x for x in (low.get(t), own) if x is not None), default=None)
    return sorted(((own, d, low[t], own == low[t]) for (own, _), d, t in zip(rows, degree, top, strict=True)), key=str)


def got(spark, rows):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, kept string")
    return sorted(map(tuple, near_vectors.near_vectors(table).collect()), key=str)


def family(rng, width, n, noise):
    base = rng.normal(size=width)
    return [(base + rng.normal(size=width) * noise).tolist() for _ in range(n)]


@pytest.mark.parametrize("block", [1024, 16])
def test_equal_to_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    vs = [rng.normal(size=64).tolist() for _ in range(250)]
    vs += family(rng, 64, 70, 0.1) + family(rng, 64, 25, 0.25) + [vs[0]] * 12 + [[3 * x for x in vs[1]]]
    order = rng.permutation(len(vs))
    rows = [(int(k), vs[at]) for k, at in enumerate(order)]
    want, found = restated(rows), got(spark, rows)
    if block == 16:
        assert found == want
    links = lambda x: sum(r[1] for r in x)
    assert links(found) >= 0.995 * links(want) and all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(found, want, strict=True))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, None), (8, [nan, 1.0]), (7, [None, 1.0]), (6, [inf, 1.0]), (5, [0.0, 0.0]), (4, []), (3, [1e200, 1e200]), (2, [1e-200, 1e-200]), (1, [1.0, 1.0, 0.0]), (3, [-1.0, 0.0]),
            (None, [0.0, -1.0]), (None, [-0.0, -1.0]), (None, [1.0, 0.99]), (30, [-1.0, -0.0]), (31, [-1.0, 0.0])]
    assert got(spark, rows) == restated(rows)
    table = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert near_vectors.near_vectors(table).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = near_vectors.unit(rng.normal(size=(4000, 64)))
    other = rng.normal(size=x.shape)
    other = near_vectors.unit(other - (other * x).sum(axis=1, keepdims=True) * x)
    for cosine in (0.0, 0.5, 0.9, 0.99):
        y = cosine * x + np.sqrt(1 - cosine * cosine) * other
        both = np.concatenate([x, y])
        told = near_vectors.Estimates(64, *near_vectors.codes(both, 230), 230, cosine)
        left, right = told.left[:4000], told.right[4000:]
        over, scale = (left * right).sum(axis=1), -(left[:, -2:] * right[:, -2:]).sum(axis=1) / max(cosine, 1e-9)
        error = np.sqrt((told.spread[:4000] * told.against[4000:]).sum(axis=1))
        assert abs(over.mean()) < 4 * over.std() / np.sqrt(4000)
        assert (np.abs(over) <= near_vectors.DEVIATIONS * error).mean() > 0.9995
        if cosine:
            assert (over / scale).std() < 0.08


def test_bands_reach_the_recall():
    agree = 1 - np.arccos(0.9) / np.pi
    for n in (0, 500, 50_000, 10_000_000, 10_000_000_000):
        bits, number = near_vectors.banding(n)
        assert 1 - (1 - agree ** bits) ** number >= near_vectors.RECALL
