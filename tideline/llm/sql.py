"""DuckDB statements that restate operators over whole tables, where SQL can."""

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SOURCE_MIX = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':7:' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), a AS (SELECT *, least(4, length(size::VARCHAR))::BIGINT AS appeal FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS words, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM a GROUP BY source
), s1 AS (
  SELECT *, (3 * words)::DOUBLE AS room, sum(words) OVER ()::DOUBLE AS all_words FROM s
), s2 AS (
  SELECT *, (all_words - coalesce(sum(room) OVER (ORDER BY room / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY room / weight, weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1
), t AS (SELECT source, words AS source_size, least(room, max(level) OVER () * weight) AS target FROM s2),
l AS (
  SELECT a.source, appeal, sum(size)::BIGINT AS words, any_value(target) AS target
  FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source GROUP BY a.source, appeal HAVING sum(size) > 0
), l1 AS (
  SELECT *, (3 * words)::DOUBLE AS room, appeal * words::DOUBLE AS weight FROM l
), l2 AS (
  SELECT *, (target - coalesce(sum(room) OVER (PARTITION BY source ORDER BY room / weight, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (PARTITION BY source ORDER BY room / weight, weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l1
), l3 AS (SELECT *, round(least(3.0::DOUBLE, max(level) OVER (PARTITION BY source) * appeal), 9) AS expected FROM l2),
l4 AS (
  SELECT source, appeal, floor(expected) AS sure, expected - floor(expected) AS chance,
         target - sum(floor(expected) * words) OVER (PARTITION BY source) AS open FROM l3
), r AS (
  SELECT a.*, coalesce(sure, 0)::BIGINT AS sure, open, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank
  FROM a LEFT JOIN l4 ON a.source IS NOT DISTINCT FROM l4.source AND a.appeal = l4.appeal
), h AS (
  SELECT *, rank IS NOT NULL AND sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size, row_no ROWS UNBOUNDED PRECEDING) <= open AS hit FROM r
), o AS (
  SELECT source, any_value(open) - sum(CASE WHEN hit THEN size ELSE 0 END) AS rest FROM h WHERE rank IS NOT NULL GROUP BY source
), n AS (
  SELECT row_no FROM (
    SELECT row_no, row_number() OVER (PARTITION BY h.source ORDER BY abs(size - rest), rank, row_no) AS k
    FROM h JOIN o ON h.source IS NOT DISTINCT FROM o.source
    WHERE NOT hit AND rank IS NOT NULL AND size > 0 AND abs(size - rest) < rest) WHERE k = 1
)
SELECT doc_id, size, source_size, target, ((sure + hit::BIGINT + (row_no IN (SELECT row_no FROM n))::BIGINT) * size)::BIGINT AS taken
FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source
"""

CONTAMINATION = rf"""
WITH doc_words AS (SELECT DISTINCT doc_id, text, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
item_words AS (SELECT DISTINCT item_id, text, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT row_number() OVER () AS item, item_id, s, len(s) AS n FROM (
    SELECT item_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM item_words WHERE len(w) > 0)
), parts AS (SELECT item, item_id, n, unnest(s) AS x FROM items),
docs AS (
  SELECT row_number() OVER () AS doc, doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM doc_words WHERE len(w) > 0
), hits AS (
  SELECT doc, any_value(doc_id) AS doc_id, item, any_value(item_id) AS item_id, any_value(n) AS n, count(*) AS shared
  FROM (SELECT doc, doc_id, unnest(s) AS x FROM docs) JOIN parts USING (x) GROUP BY doc, item
)
SELECT doc_id, item_id, shared, n AS item_shingles, shared::DOUBLE / n AS containment FROM hits WHERE shared >= 0.8 * n - 1e-9
"""

CHAT_FORMAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
         replace(replace(replace(replace(text, '\', '\b'), '<turn:', '\o'), '</turn>', '\c'), '<merge/>', '\m') AS safe,
         replace(replace(replace(replace(replace(role, '\', '\b'), '<turn:', '\o'), '</turn>', '\c'), '<merge/>', '\m'), '>', '\g') AS mark
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe) + CASE WHEN k = 1 OR before <> role THEN length(mark) + 15 ELSE 8 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""

TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.i <> c.i
), r AS (SELECT query_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

LINE_SPREAD = """
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT row_no, site, lines, unnest(lines) AS raw, unnest(range(0, len(lines))) AS pos FROM d),
k AS (
  SELECT row_no, site, raw, pos, trim(raw) AS line,
         list_aggregate(list_transform(list_filter(lines, lambda x: trim(x) <> '' AND trim(x) <> trim(raw)), lambda x: {'n': length(x), 'x': x}), 'max').x AS companion
  FROM l
),
b AS (SELECT line FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10 AND count(DISTINCT companion) >= 10),
g AS (
  SELECT row_no, string_agg(raw, chr(10) ORDER BY pos) FILTER (line NOT IN (SELECT line FROM b)) AS kept,
         count(*) FILTER (line IN (SELECT line FROM b)) AS gone FROM k GROUP BY row_no
), o AS (SELECT d.*, coalesce(gone, 0) AS gone, CASE WHEN gone > 0 THEN coalesce(kept, '') ELSE text END AS cleaned FROM d LEFT JOIN g USING (row_no))
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, gone AS n_removed, length(cleaned) AS kept_chars, md5(cleaned) AS kept_md5 FROM o
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), u AS (SELECT i, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.i, b.i AS j FROM u a JOIN u b ON a.i <> b.i AND len(a.v) = len(b.v)
  WHERE list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) / (a.size * b.size) >= 0.9
), r AS (SELECT i, i AS j FROM v UNION SELECT r.i, l.j FROM r JOIN l ON l.i = r.j),
c AS (SELECT r.i, min(v.vec_id) AS component_id FROM r JOIN v ON v.i = r.j GROUP BY r.i)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.i = v.i) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (i)
"""

PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size
), f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY lang, size, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * k.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c))
  ) GROUP BY lang, phrase
), o AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _vector_codes(rounds: int = 6) -> str:
    """The rounds one after the other: a<k> assigns every part, c<k> moves the entries."""
    steps = [f"""
k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE}),
e AS MATERIALIZED (SELECT vec_id, d // (w // 8) AS part, d % (w // 8) AS pos, x FROM (SELECT vec_id, len(v) AS w, unnest(range(0, len(v))) AS d, unnest(v) AS x FROM k)),
c0 AS MATERIALIZED (SELECT part, entry, pos, x FROM e JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 16) USING (vec_id))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, part, min(apart * 16 + entry) % 16 AS entry, min(apart) AS apart FROM (
    SELECT e.vec_id, e.part, c.entry, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS apart FROM e JOIN c{i} c USING (part, pos) GROUP BY e.vec_id, e.part, c.entry
  ) GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce((s - ((s % n + n) % n)) // n, c.x)::BIGINT AS x FROM c{i} c LEFT JOIN (
    SELECT a.part, a.entry, e.pos, sum(e.x)::BIGINT AS s, count(*) AS n FROM a{i} a JOIN e ON a.vec_id = e.vec_id AND a.part = e.part GROUP BY a.part, a.entry, e.pos
  ) m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)""")
    return "WITH " + ",\n".join(steps) + f"""
, o AS (SELECT vec_id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM o JOIN k USING (vec_id)
"""


def all_sql() -> dict[str, str]:
    return {"op3_source_mix": SOURCE_MIX, "op6_contamination": CONTAMINATION, "op7_chat_format": CHAT_FORMAT, "op9_topk": TOPK, "op10_line_spread": LINE_SPREAD,
            "op11_near_vectors": NEAR_VECTORS, "op12_phrases": PHRASES, "op13_vector_codes": _vector_codes()}
