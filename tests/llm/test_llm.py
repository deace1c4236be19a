"""Edge cases of every operator of the subpackage, and plain restatements where SQL has none."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from tideline.llm import chat_format, common, contamination, language, line_spread, passages, pitman_yor, quality, queries, simhash, source_mix, sql, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(n))


ODD = [(None, None, None, None, "x"), (None, "", "a", "en", "x"), (1, "", "a", None, "x"), (1, "", "a", None, "x"), (2, " \t\n", "b", "en", "x"),
       (3, words(40_000, 3), "b", "en", "x"), (4, words(60, 4), None, "fr", "x"), (4, words(60, 4), None, "fr", "x"), (5, "one", "c", "en", "x")]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (7, 9)] + [(k, k + 1) for k in range(100, 140)], "a long, b long")
    got = {r.node: r.label for r in common.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {k: 100 for k in range(100, 141)}
    assert common.components(edges.limit(0)).count() == 0


def test_quality_keeps_columns_of_any_type_and_name(docs, spark):
    rows = docs([(k, "Good words here. " * 5 if k % 2 else "BUY!! 9 9 9 " * 5, "s", "en", "x") for k in range(20)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    wide = rows.select("doc_id", "text", F.lit(0.25).alias("x"), F.lit("old").alias("score"), F.lit(1.5).alias("doc"),
                       F.array(F.lit(1), F.lit(None)).alias("a.b"), F.current_timestamp().alias("c0"), F.map_from_arrays(
                           F.array(F.lit("k")), F.array(F.col("doc_id"))).alias("m"), F.lit(None).cast("date").alias("day"))
    model = quality.learn(rows, labels)
    out = quality.score(wide.union(wide.where("doc_id = 1")), model)
    assert out.columns == ["doc_id", "x", "doc", "a.b", "c0", "m", "day", "score", "predicted"]
    assert out.schema["c0"].dataType == wide.schema["c0"].dataType and out.schema["m"].dataType == wide.schema["m"].dataType
    got = out.collect()
    plain = {r.doc_id: r.score for r in quality.score(rows.select("doc_id", "text"), model).collect()}
    assert len(got) == 21 and all(r.score == plain[r.doc_id] and r.x == 0.25 and r["a.b"] == [1, None] and r.m == {"k": r.doc_id} for r in got)
    assert len(set(plain.values())) == 2 and {r.predicted for r in got if r.doc_id % 2} == {1} and {r.predicted for r in got if r.doc_id % 2 == 0} == {0}


def test_quality(docs, spark):
    good = [words(80, k) + "." for k in range(30)]
    bad = ["!!! ".join(["AB"] * 60) for _ in range(10)]
    rows = docs([(k, t, "s", "en", "x") for k, t in enumerate(good + bad)])
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(40)] + [(None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(rows.select("doc_id", "text"), quality.learn(rows, labels)).collect()}
    assert all(got[k].predicted == int(k < 30) for k in range(40)) and all(0 <= r.score <= 1 for r in got.values())
    odd = quality.score(docs(ODD).select("doc_id", "text"), quality.learn(docs(ODD), labels.limit(0))).collect()
    assert len(odd) == len(ODD) and {r.score for r in odd} == {0.5}
    assert quality.score(rows.limit(0).select("doc_id", "text"), quality.learn(rows, labels)).count() == 0


def test_upper_share_of_a_long_text_with_a_dotted_capital():
    text = "\u0130" + "ab " * 400_000
    assert quality.features(text)[3] == pytest.approx(1 / len(text))


def test_pitman_yor(docs):
    text = " ".join(["the cat sat on a mat", "The dog sat on a log"] * 20)
    rows = docs([(1, text, "s", "en", "x"), (2, None, "s", "en", "x"), (3, "unseen words", "s", "en", "x"), (3, "unseen words", "s", "en", "x")]).select("doc_id", "text")
    model = pitman_yor.learn(rows.where("doc_id < 3"))
    got = sorted(map(tuple, pitman_yor.score(rows, model, ["doc_id"]).collect()))
    tokens = WORD.findall(low(text)) + ["", ""]
    assert [g[:4] for g in got] == [(1, len(tokens) - 1, len(tokens) - 1, len(tokens)), (2, 1, 1, len(tokens)), (3, 3, 1, len(tokens)), (3, 3, 1, len(tokens))]
    v = len(set(tokens))
    base = sum(np.log10((tokens.count(t) + 1) / (len(tokens) + v + 1)) for t in tokens[:-1])
    assert got[0][4] == pytest.approx(base) and got[0][5] > got[0][4]
    # whatever the context, the probabilities of all words and the unknown one add up to 1
    table = model.words.toPandas()
    for ctx in range(4):
        total = model.unknown @ model.backoffs[:, ctx] / len(model.unknown)
        for _, r in table.iterrows():
            extra = np.frombuffer(r["extra"], pitman_yor.EXTRA)
            total += pitman_yor._probabilities(np.frombuffer(r["roots"], np.float32)[None, :], np.array([ctx]), extra["p"][extra["ctx"] == ctx].sum(), model.backoffs)[0]
        assert total == pytest.approx(1, abs=1e-4)
    # words outside the broadcast table score the same through the join
    few = pitman_yor.learn(rows.where("doc_id < 3"), frequent=64)
    few.vocabulary = few.vocabulary[:3]
    assert pitman_yor.score(rows, few, ["doc_id"]).count() == 4
    empty = pitman_yor.learn(rows.limit(0))
    assert [r.score for r in pitman_yor.score(rows.where("doc_id = 1"), empty, ["doc_id"]).collect()] == [pytest.approx(0)]


def test_reseating_keeps_customers():
    rng = np.random.default_rng(1)
    of, stay, customers = np.array([2, 0, 0, 1]), np.array([5, 0, 2, 1]), np.array([9, 0, 3, 200_000])
    for _ in range(5):
        of, stay = pitman_yor._reseated(of, stay, customers, np.full(4, 2.0), 0.5, rng)
        assert (stay > 0).all() and np.bincount(of, stay, 4).tolist() == customers.tolist()


def test_source_mix(docs):
    rows = docs([(k, words(20 + k % 17, k), "abc"[k % 3] if k % 10 else None, "en", "x") for k in range(600)] + ODD)
    got = source_mix.mix(rows).collect()
    assert len(got) == 600 + len(ODD) and source_mix.mix(rows).exceptAll(source_mix.mix(rows)).count() == 0
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        by[r.source_size, r.target].append(r)
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(60, 0.01 * target) or max(r.size for r in own) > 1000
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in got))
    assert source_mix.mix(rows.limit(0)).count() == 0
    mixed = source_mix.mixed_documents(rows)
    assert mixed.agg(F.sum(F.col("copies") * common.word_count(F.col("text")))).first()[0] == sum(r.taken for r in got)


def test_passages(docs):
    shared, near = words(60, 1), words(150, 2)
    changed = near.replace(near.split()[75], "zzzzz")
    rows = docs([(1, words(50, 10) + " " + shared + " " + words(50, 11), "s", "en", "x"), (2, words(70, 12) + "\n" + shared.upper(), "s", "en", "x"),
                 (3, words(33, 13) + " " + near, "s", "en", "x"), (4, changed + " " + words(45, 14), "s", "en", "x"), (5, words(400, 15), "s", "en", "x")])
    got = passages.repeated_passages(rows).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4} and {r.doc_id for r in got if r.removed} == {2, 4}
    assert all(r.first_doc_id == {1: 1, 2: 1, 3: 3, 4: 3}[r.doc_id] for r in got)
    cleaned = {r.doc_id: r.text for r in passages.without_repeats(rows).collect()}
    assert cleaned[1] == rows.where("doc_id = 1").first().text and len(cleaned[2]) < len(rows.where("doc_id = 2").first().text) - 150
    assert {r.doc_id for r in passages.repeated_passages(docs(ODD)).collect()} <= {4}
    assert passages.repeated_passages(rows.limit(0)).count() == 0
    p = 1 - (1 - passages.THRESHOLD ** passages.ROWS) ** passages.tuned_bands()
    assert p >= passages.RECALL


def test_short_and_edited_passages(docs):
    """51-word passages inside unlike texts: whole if equal; with one word changed, whole but for tails without a five-word run."""
    rows, want = [], {}
    for k in range(60):
        shared = words(51, 9000 + k).split()
        edited = list(shared)
        if k % 2:
            edited[5 + k % 41] = "zzzzz"
        front = 10 + k
        rows += [(k, f"{words(40, k)} {' '.join(shared)} {words(30, 1000 + k)}", "s", "en", "x"), (500 + k, f"{words(front, 2000 + k)} {' '.join(edited)} {words(30, 3000 + k)}", "s", "en", "x")]
        want[500 + k] = (front, 51)
    got = {r.doc_id: r for r in passages.repeated_passages(docs(rows)).where("removed").collect()}
    assert {d: (r.start, r.words) for d, r in got.items()} == want
    assert all(r.first_doc_id == d - 500 for d, r in got.items())
    cleaned = {r.doc_id: r.text for r in passages.without_repeats(docs(rows)).collect()}
    assert all(cleaned[500 + k] == f"{words(10 + k, 2000 + k)} {words(30, 3000 + k)}" and cleaned[k] == rows[2 * k][1] for k in range(60))
    twice = "a b " * 40
    assert passages.without_repeats(docs([(1, twice.strip(), "s", "en", "x")])).first().text.split() == twice.split()[:20]


def test_language(docs, spark):
    rows = docs(ODD).select("doc_id", "text", "lang").withColumn("letters", language.has_letter(F.col("text")))
    model = language.learn(rows)
    got = language.predict(rows.drop("lang"), model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} <= {"en", "fr", "und"} and sum(r.lang_pred == "und" for r in got) == 5
    nothing = language.predict(rows.drop("lang"), language.learn(rows.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    held = queries.op5_language(spark, SF).where("held_out").join(common.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    slices = np.sort(np.concatenate(list(language.gram_buckets("ab" * 300_000))))
    assert len(slices) == 3 * (600_002) - 3


def test_contamination(docs, spark):
    items = spark.createDataFrame([(1, words(40, 1)), (1, words(40, 1)), (2, words(3, 2)), (3, ""), (None, words(30, 5)), (4, None)], "item_id long, text string")
    rows = docs([(10, words(3000, 6) + " " + words(40, 1).upper() + " " + words(9000, 7), "s", "en", "x"), (11, words(3, 2), "s", "en", "x"), (12, words(3, 2) + " more", "s", "en", "x"),
                 (13, words(30, 5) + " " + words(5, 8), "s", "en", "x"), (14, " ".join(words(40, 1).split()[:20]), "s", "en", "x")] + ODD)
    got = sorted((r.doc_id, r.item_id or 0, r.containment) for r in contamination.contaminated(rows, items).collect())
    assert got == [(10, 1, 1.0), (11, 2, 1.0), (13, 0, 1.0)]
    kept = contamination.decontaminated(rows, items)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 3
    assert contamination.contaminated(rows, items.limit(0)).count() == 0 and contamination.contaminated(rows.limit(0), items).count() == 0


def test_chat_format(spark):
    hard = "a\\b<turn:x></turn>\n<merge/>\\o\\\\c"
    rows = [(1, 2, "assistant", hard), (1, 1, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (2, None, None, "x"), (None, 1, "a>b", hard), (3, 1, "assistant", "é" * 9)]
    turns = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    out = chat_format.format_conversations(turns)
    got = {r.conv_id: r for r in chat_format.digest(out).collect()}
    for conv in (1, 2, 3, None):
        own = sorted((r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out.where("conv_id = 1").first().formatted.count("<turn:") == 2
    assert chat_format.digest(chat_format.format_conversations(turns.limit(0))).count() == 0


def fingerprint(t):
    w = WORD.findall(low(t))
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, spark):
    got = queries.op8_simhash(spark, SF).collect()
    texts = {r.doc_id: fingerprint(r.text) for r in common.table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{x:016x}" for d, x in texts.items()}
    kept = simhash.one_of_each(docs(ODD))
    assert kept.columns == docs(ODD).columns
    assert sorted((r.doc_id or 0, len((r.text or "").split())) for r in kept.collect()) == [(1, 0), (3, 40_000), (4, 60), (5, 1)]
    assert simhash.one_of_each(docs([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_whatever_its_doc_ids(docs):
    """Groups that share a doc_id each keep one document; null ids of near fingerprints are one group."""
    a, b, c = words(60, 21), words(60, 22), words(60, 23)
    rows = docs([(5, a, "s", "en", "x"), (5, b, "s", "en", "x"), (9, b, "s", "en", "x"), (None, c, "s", "en", "x"), (None, c + " ", "s", "en", "x")])
    kept = [(r.doc_id, r.text.strip()) for r in simhash.one_of_each(rows).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (5, b), (None, c)], key=str)


@pytest.mark.parametrize("dense", [False, True])
def test_simhash_links(spark, dense):
    rng, base = random.Random(5), random.Random(6).getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(300 if dense else 20):
        x = base if dense else rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    rows = common.staged(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"), "t")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    top = list(range(len(signed)))
    for i in range(len(signed)):
        for j in range(i):
            if ((signed[i] ^ signed[j]) & ((1 << 64) - 1)).bit_count() <= 2:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    assert got == dict(enumerate(top))


def test_topk(spark):
    rng = np.random.default_rng(3)
    vs = [rng.normal(size=16).tolist() for _ in range(300)] + [[1.0] * 16] * 5 + [[0.0] * 16]
    rows = [(k, v) for k, v in enumerate(vs)] + [(900, None), (901, [float("nan")] * 16), (902, [None] * 16), (903, [float("inf")] * 16), (None, [1.0] * 16)]
    vectors = topk.numbered(topk.quantized(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e"))
    got = topk.top_k(vectors, vectors.where("id % 50 = 0"), 5, shard=64, block=4).collect()
    ints = {k: np.floor(np.array(v) * 256).astype(int) for k, v in rows[:306]}
    want = {(q, n + 1, *x) for q in range(0, 306, 50) for n, x in enumerate(sorted(((k, int(v @ ints[q])) for k, v in ints.items() if k != q), key=lambda x: (-x[1], x[0]))[:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0 and topk.top_k(vectors.where("id < 2"), vectors.where("id = 0")).count() == 1


def test_topk_of_repeated_ids(spark):
    """Every query row has its own list, and rows that share its id are candidates like any other."""
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), *((k, [k / 8, 0.0]) for k in range(1, 8)), (7, [7 / 8, 0.0])]
    vectors = topk.numbered(topk.quantized(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e"))
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("id = 0"), 5).collect())
    want = []
    for at in (0, 1):
        scores = sorted((-int(rows[at][1][0] * 256) * int(v[0] * 256), i) for n, (i, v) in enumerate(rows) if n != at)
        want += [(n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    assert got == sorted(want)


def test_line_spread_of_a_longest_line(docs):
    """A notice that is the longest line of every document it stands in, and one that is all of a document."""
    notice, alone = words(60, 900), words(50, 901)
    rows = [(k, f"{words(9, k)}\n{notice}", f"s{k}", "en", "x") for k in range(30)] + [(100 + k, alone + "\n \n", f"s{k}", "en", "x") for k in range(30)]
    got = {r.doc_id: r for r in line_spread.without_boilerplate(docs(rows)).collect()}
    assert all(got[k].n_removed == 1 and got[k].text == words(9, k) for k in range(30))
    assert all(got[100 + k].n_removed == 0 for k in range(30))


def test_line_spread(docs):
    rows = [(k, f"{words(12, k)}\n  shared line \n\n{words(9, k + 500)}", f"s{k % 12}", "en", "x") for k in range(40)]
    rows += [(100 + k, words(12, 77) + "\n" + words(13, 78), f"s{k % 12}", "en", "x") for k in range(40)]  # copies on many sites are no boilerplate
    got = {r.doc_id: r for r in line_spread.without_boilerplate(docs(rows)).collect()}
    assert all(got[k].n_removed == 1 and got[k].text == f"{words(12, k)}\n\n{words(9, k + 500)}" for k in range(40))
    assert all(got[100 + k].n_removed == 0 for k in range(40))
    odd = line_spread.without_boilerplate(docs(ODD)).collect()
    assert len(odd) == len(ODD) and sum(r.n_removed for r in odd) == 0 and sorted(r.n_lines for r in odd)[0] == 0
    assert line_spread.without_boilerplate(docs(rows).limit(0)).count() == 0


def test_stages_keep_columns_and_run(docs, spark):
    clashes = ("copies", "fp", "__id", "__text", "__rows", "doc", "id_key", "text_key", "keep", "gone", "n", "rows", "n_lines", "n_removed", "size", "a b")
    rows = common.table(spark, SF, "documents").withColumns({c: F.lit(f"{c}!") for c in clashes})
    before = rows.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.staged(stage(spark, rows, SF), name)
        assert out.count() <= before and 0 < out.count()
        if name != "source_mix":
            assert out.columns == rows.columns
        assert all(out.where(F.col(f"`{c}`") != f"{c}!").count() == 0 for c in clashes[1:])
        before, rows = out.count(), out
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs([]), SF).count() == 0


def test_folds_match_crc32(spark):
    got = spark.range(50).select("id", common.fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in got)


def test_queries_without_sql_are_the_learned_and_hashed_ones():
    q, o = queries.all_queries(), sql.all_sql()
    assert set(o) <= set(q) and len(q) == 13
    assert set(q) - set(o) == {"op1_quality", "op2_lm_score", "op4_repeated_passages", "op5_language", "op8_simhash"}
    assert corpus_pipeline.ORACLE_SQL is None and {*q, "pipeline"} <= set(entry_points.queries())
