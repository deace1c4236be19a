import random

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import contamination as C


def sentence(n, seed, words=300):
    r = random.Random(seed)
    return " ".join("w%d" % r.randrange(words) for _ in range(n))


def bits(values):
    found = np.zeros(1 << C.FILTER_BITS, bool)
    found[C._bits(values.view(np.uint64))] = True
    return np.packbits(found)


ITEMS = [sentence(20, 1), sentence(60, 2)]
PARTS = [np.unique(C.shingles(x.encode().split())) for x in ITEMS]
BANDS = np.array([C._band(C.size_class(len(p)), k, v) for p in PARTS for k, v in enumerate(C.minima(p))], np.int64)


class Shared:
    """What the search reads of two items: of 20 and of 60 words."""

    value = (sorted((C.size_class(len(p)), 0.8 * len(p) - 1e-9) for p in PARTS), bits(np.concatenate(PARTS)), bits(BANDS))


def search(texts):
    batch = pa.record_batch({"id_key": pa.array(map(str, range(len(texts)))), "text_key": pa.array(range(len(texts)), pa.int64()),
                             "doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array([t.encode() for t in texts], pa.binary())})
    return [r for out in C._search(Shared)(iter([batch])) for r in out.to_pylist()]


@pytest.mark.parametrize("shared, classes", [(5, 0), (12, 0), (17, 1), (20, 1)])
def test_windows_are_cut_only_where_an_item_may_be_whole(monkeypatch, shared, classes):
    """A document with fewer of the items' shingles than 0.8 of a class's smallest item has none of that class."""
    seen, minima = [], C.minima
    monkeypatch.setattr(C, "minima", lambda parts: seen.append(len(parts)) or minima(parts))
    text = sentence(200, 3, 10**6) + " " + " ".join(ITEMS[0].split()[:shared]) + " " + sentence(200, 4, 10**6)
    got = search([text])
    assert len(got) == classes and bool(seen) == bool(classes)
    assert all(n <= 2 << C.size_class(len(PARTS[0])) for n in seen)  # no windows for the class of 60 words


def test_whole_search_against_all_pairs(spark):
    """Documents with runs of items on both sides of the threshold: the same rows as counting each pair."""
    r = random.Random(5)
    items = [(k, sentence(n, 100 + k)) for k, n in enumerate([5, 6, 9, 14, 18, 33, 40, 70, 130] * 3)] + [(90, "two words"), (91, None)]
    texts = ["two words", "", None]
    for k in range(300):
        own = r.choice(items[:27])[1].split()
        keep = round(len(own) * r.choice([0.6, 0.75, 0.8, 0.85, 0.9, 1]))
        texts.append(" ".join([sentence(r.randrange(120), 1000 + k), *own[:keep], sentence(r.randrange(120), 2000 + k)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.shared, x.item_shingles) for x in C.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect())

    def parts(text):
        words = (text or "").split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    cut = {i: parts(t) for i, t in items}
    wanted = sorted((d, i, len(own & parts(t)), len(own)) for d, t in enumerate(texts) for i, own in cut.items() if own and len(own & parts(t)) >= 0.8 * len(own))
    assert got == wanted and len(got) > 50
