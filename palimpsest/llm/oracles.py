"""DuckDB SQL for the corpus queries that SQL can express."""

from . import quality_rules

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_FAILS = r"""
       (len(regexp_extract_all({0}, '(!!|\?\?|[#*$%&]{{3}})([\x20\x09-\x0D]|$)')) * 3 >= len({1})
        OR (len(regexp_extract_all({0}, '[|»›>·•]')) * 3 >= len({1}) AND len(regexp_extract_all({0}, '[|»›>·•]')) >= 2)
        OR (len({1}) < 4 AND NOT regexp_matches({0}, '[.!?:;,…"''”’)\]][\x20\x09-\x0D]*$'))
        OR len(regexp_extract_all({0}, '(?i)NOTICE')) * 12 >= len({1}) AND regexp_matches({0}, '(?i)NOTICE'))
""".replace("NOTICE", quality_rules.BOILERPLATE.replace("'", "''"))

SQL: dict[str, str] = {
    "op3_quality_rules": f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {_WORDS.format("text")} AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
p AS (SELECT r, i, w[i:i + 4] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM p) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (SELECT unnest(range(5)) AS k) GROUP BY r),
x AS (SELECT w.r, doc_id, len(w) AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(list_sum(list_transform(list_filter(lines, lambda l: {_FAILS.format("l", _WORDS.format("l"))}), lambda l: len({_WORDS.format("l")}))), 0) AS lost
      FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * n_words AS kept
FROM x""",
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT n, h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY n, h)
SELECT page_id, p.n AS payload_bytes, p.h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.n = f.n AND p.h = f.h""",
    "op7_line_dedup": r"""
WITH l AS (SELECT r, doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT r, l.doc_id, n, line, k.key IS NOT NULL AND keeper <> l.doc_id AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY r, doc_id""",
    "op9_decontaminate": r"""
WITH low AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, doc_id, row_number() OVER () AS r FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, n, i, w[i:i + n - 1] AS win FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v))),
m AS (SELECT DISTINCT r, p.n, i, item_id FROM p JOIN v ON p.n = v.n AND p.win = v.win),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)""",
}

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DOT = "list_dot_product({0}, {1})::BIGINT"
_SQUARES = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _clusters(rounds: int) -> str:
    """Plain rounds of clustering: c are the centroids of a round, a is what they assign."""
    sql = f"""WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_WHOLE} AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v AS m FROM (SELECT v, sha256('3:' || vec_id) AS h FROM e ORDER BY h LIMIT 8))"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT vec_id, v, d.c AS c, d.d AS d FROM (SELECT vec_id, e.v, min({{'d': {_SQUARES.format("e.v", "m")}, 'c': c}}) AS d FROM e, c{r} GROUP BY vec_id, e.v))"""
        if r < rounds:
            sql += f""",
s{r} AS (SELECT c, i, floor(sum(x)::HUGEINT / count(*))::BIGINT AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{r} GROUP BY c) n ON n.c = c{r}.c)"""
    return f"""{sql}
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""


SQL |= {
    "op11_hard_negatives": f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, {_DOT.format("a.v", "b.v")} AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id))::INT AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
    "op12_yinyang": _clusters(10),
    "op13_knn_join": f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE {_WHOLE})
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT.format("q.v", "b.v")} DESC, b.vec_id))::INT AS rank, b.vec_id, {_DOT.format("q.v", "b.v")} AS score
FROM e q JOIN e b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 20""",
}
