"""Hybrid search over chunks: five channels, modes, a failing provider, entities by alias and moment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, search
from ..operators.state import cut_round
from ..sources.tables import EDGES_SQL, ENTITIES_SQL, PAGES_SQL, PART, current, edges, entities, pages, table
from .base import query
from .retrieval import DEG_SQL, TRI_SQL

NOW = "2024-02-01 00:00:00"
#: number, text, terms, a vector by its id, mode, domain, project, as of, limit; then what the text says: counting, anchor.
ASKED = [
    (1, "what is in JAPAN and Customer#000000012", "the and", 3, "hybrid", None, None, None, 10, False, None),
    (2, "how many with Supplier#000000003 on 2024-01-10?", "de la", 17, "hybrid", None, "fr", None, 12, True, "2024-01-10"),
    (3, "EUROPE and Customer#000000013 then", "und der", 42, "hybrid", None, None, "2024-01-20 00:00:00", 8, False, None),
    (4, "whatever is near", "none of these", 99, "vector", None, None, None, 5, False, None),
    (5, "what is written", "that with", 7, "fts", "src3", None, None, 7, False, None),
    (6, "customer 000000077 nation on January 5, 2024", "sie die", 256, "hybrid", "src1", "de", None, 6, False, "2024-01-05"),
]
WALKED = ["depends_on", "located_in"]
HUB = 100


def _cell(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else f"'{v}'"


_Q = f"""q AS (SELECT question_id, text, terms, vec_id, mode, domain, project, as_of::TIMESTAMP AS as_of, lim, is_count, anchor::DATE AS anchor, CASE WHEN mode = 'hybrid' THEN greatest(50, 5 * lim) ELSE lim END AS pool
  FROM (VALUES {', '.join('(' + ', '.join(map(_cell, r)) + ')' for r in ASKED)}) v(question_id, text, terms, vec_id, mode, domain, project, as_of, lim, is_count, anchor))"""
_VISIBLE = "(q.domain IS NULL OR p.domain = q.domain) AND (q.project IS NULL OR p.project IS NULL OR p.project = q.project)"
_CORPUS = f"""{PAGES_SQL}, {ENTITIES_SQL}, {EDGES_SQL}, {DEG_SQL},
c0 AS (SELECT page_id, content, created_at, unnest(range(0, greatest(1, ceil((length(content) - 200) / 1300.0))::INT)) AS position FROM pages_),
c AS (SELECT page_id * 1000 + position AS item_id, page_id, position, substr(content, position * 1300 + 1, 1500) AS text, strftime(created_at, 'd%Y%m%d') AS token, created_at::DATE AS day, embedding
  FROM c0 LEFT JOIN embeddings ON vec_id = page_id AND position = 0),
durable AS (SELECT DISTINCT page_id FROM edges WHERE page_id IS NOT NULL AND (from_id - {PART} BETWEEN 1 AND 20 OR to_id - {PART} BETWEEN 1 AND 20)),
en AS (SELECT *, CASE WHEN kind = 'place' THEN [name] ELSE [] END AS aliases, TIMESTAMP '1995-01-01' AS valid_from, CASE WHEN kind = 'person' AND entity_id % 10 = 3 THEN TIMESTAMP '2024-02-01' - INTERVAL 1 DAY END AS valid_to FROM entities)"""
_DOT = "list_dot_product({a}.embedding::DOUBLE[], {b}.embedding::DOUBLE[])"
_VECTOR = f"""r_vector AS (SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY round(d, 9), item_id) AS rank, any_value(pool) OVER (PARTITION BY question_id) AS pool FROM (
  SELECT q.question_id, q.pool, c.item_id, 1 - {_DOT.format(a='c', b='v')} / (sqrt({_DOT.format(a='c', b='c')}) * sqrt({_DOT.format(a='v', b='v')})) AS d
  FROM q JOIN embeddings v ON v.vec_id = q.vec_id JOIN c ON c.embedding IS NOT NULL JOIN pages_ p ON p.page_id = c.page_id WHERE mode IN ('hybrid', 'vector') AND {_VISIBLE}) WHERE d <= 1.0 QUALIFY rank <= pool)"""
_FTS = rf"""tok AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS term FROM c), sz AS (SELECT item_id, count(*) AS size FROM tok GROUP BY item_id),
ask AS (SELECT DISTINCT question_id, unnest(string_split(terms, ' ')) AS term FROM q WHERE mode IN ('hybrid', 'fts')), hit AS (SELECT a.question_id, t.item_id, a.term, count(*) AS tf FROM ask a JOIN tok t ON t.term = a.term GROUP BY ALL),
f AS (SELECT question_id, item_id, round(sum((1 + ln(tf)) / (1 + ln(size))), 9) AS s FROM hit JOIN sz USING (item_id) GROUP BY question_id, item_id HAVING count(*) = (SELECT count(*) FROM ask a WHERE a.question_id = hit.question_id)),
r_fts AS (SELECT f.question_id, f.item_id, row_number() OVER (PARTITION BY f.question_id ORDER BY s DESC, f.item_id) AS rank FROM f JOIN q USING (question_id) JOIN c ON c.item_id = f.item_id JOIN pages_ p ON p.page_id = c.page_id WHERE {_VISIBLE} QUALIFY rank <= any_value(q.pool) OVER (PARTITION BY f.question_id))"""
_SEEDS = f"""names AS (SELECT 'q' || question_id AS key, text FROM q WHERE mode = 'hybrid' UNION ALL SELECT 'e' || entity_id, name FROM en), {TRI_SQL},
like_ AS (SELECT substr(a.key, 2)::INT AS question_id, substr(b.key, 2)::BIGINT AS entity_id, round(count(*)::DOUBLE / (min(x.n) + min(y.n) - count(*)), 9) AS sim
  FROM tg a JOIN tg b ON a.g = b.g JOIN tn x ON x.key = a.key JOIN tn y ON y.key = b.key WHERE a.key[1] = 'q' AND b.key[1] = 'e' GROUP BY a.key, b.key HAVING round(count(*)::DOUBLE / (min(x.n) + min(y.n) - count(*)), 9) >= 0.3),
every AS (SELECT question_id, entity_id, max(sim) AS sim FROM (FROM like_ UNION ALL SELECT question_id, entity_id, 1.0 FROM q, (SELECT entity_id, lower(unnest(aliases)) AS a FROM en) WHERE mode = 'hybrid' AND position(a IN lower(q.text)) > 0) GROUP BY ALL),
seed AS (SELECT e.*, row_number() OVER (PARTITION BY e.question_id ORDER BY sim DESC, e.entity_id) AS r FROM every e JOIN q USING (question_id) JOIN en ON en.entity_id = e.entity_id
  WHERE CASE WHEN q.as_of IS NULL THEN en.valid_to IS NULL ELSE en.valid_from <= q.as_of AND (en.valid_to IS NULL OR en.valid_to > q.as_of) END)"""


def _ranked_chunks(weights: str, name: str) -> str:
    return f"""{name} AS (SELECT w.question_id, c.item_id, row_number() OVER (PARTITION BY w.question_id ORDER BY weight DESC, c.position, c.item_id) AS rank FROM {weights} w JOIN q USING (question_id) JOIN c ON c.page_id = w.page_id JOIN pages_ p ON p.page_id = c.page_id
  WHERE {_VISIBLE} AND (q.as_of IS NULL OR p.created_at <= q.as_of) QUALIFY rank <= any_value(q.pool) OVER (PARTITION BY w.question_id))"""


_ENTITY = f"""w_entity AS (SELECT s.question_id, e.page_id, round(sum(sim / (1 + 0.001 * pow(greatest(coalesce(degree, 0) - 1, 0), 2))), 6) AS weight FROM seed s JOIN q USING (question_id) LEFT JOIN deg USING (entity_id)
  JOIN edges e ON (s.entity_id = e.from_id OR s.entity_id = e.to_id) AND (q.as_of IS NULL OR e.valid_from <= q.as_of) WHERE r <= {search.SEEDS} AND e.page_id IS NOT NULL GROUP BY ALL),
{_ranked_chunks('w_entity', 'r_entity')}"""
_DATE = f"""r_date AS (SELECT q.question_id, c.item_id, row_number() OVER (PARTITION BY q.question_id ORDER BY c.item_id) AS rank FROM q JOIN c ON c.token = strftime(q.anchor, 'd%Y%m%d') JOIN pages_ p ON p.page_id = c.page_id
  WHERE mode = 'hybrid' AND {_VISIBLE} QUALIFY rank <= any_value(q.pool) OVER (PARTITION BY q.question_id))"""
_GRAPH = f"""sure AS (SELECT from_id, to_id, confidence FROM edges WHERE confidence >= 0.5 AND kind IN ({', '.join(map(repr, WALKED))})),
op AS (SELECT b.* FROM (FROM sure UNION ALL SELECT to_id, from_id, confidence FROM sure) b JOIN deg ON deg.entity_id = to_id WHERE degree <= {HUB}),
h0 AS (SELECT question_id, entity_id, sim AS mult FROM seed WHERE r <= {search.EXPANSION_SEEDS}),
h1 AS (SELECT question_id, to_id AS entity_id, mult * confidence * 0.5 AS mult, h0.entity_id AS a FROM h0 JOIN op ON from_id = h0.entity_id WHERE to_id <> h0.entity_id),
h2 AS (SELECT question_id, to_id AS entity_id, mult * confidence * 0.5 AS mult FROM h1 JOIN op ON from_id = h1.entity_id WHERE to_id <> h1.entity_id AND to_id <> a),
best AS (SELECT question_id, entity_id, max(mult) AS mult FROM (FROM h0 UNION ALL SELECT question_id, entity_id, mult FROM h1 UNION ALL FROM h2) GROUP BY ALL),
w_graph AS (SELECT question_id, page_id, round(sum(mult), 6) AS weight FROM best JOIN (SELECT from_id AS entity_id, page_id FROM edges WHERE page_id IS NOT NULL UNION ALL SELECT to_id, page_id FROM edges WHERE page_id IS NOT NULL) USING (entity_id) GROUP BY ALL),
{_ranked_chunks('w_graph', 'r_graph')}"""
_PARTS = {"vector": _VECTOR, "fts": _FTS, "entity": f"{_SEEDS}, {_ENTITY}", "date": _DATE, "graph": _GRAPH}


def _found_sql(use) -> str:
    weight = search.scores.WEIGHTS
    return f"WITH {_Q}, {_CORPUS}, " + ", ".join(_PARTS[n] for n in use) + ", found AS (" + " UNION ALL ".join(f"SELECT question_id, item_id, '{n}' AS channel, rank, {weight[n]}::DOUBLE AS weight FROM r_{n}" for n in use) + ")"


def _search_sql(use) -> str:
    return f"""{_found_sql(use)}, fused AS (SELECT question_id, item_id, CASE WHEN q.mode = 'hybrid' THEN sum(weight / (60 + rank)) ELSE 1 / min(rank) END AS score FROM found JOIN q USING (question_id) GROUP BY question_id, item_id, q.mode),
pool_ AS (SELECT fused.* FROM fused JOIN q USING (question_id) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, item_id) <= any_value(q.pool) OVER (PARTITION BY question_id)),
known AS (SELECT f.question_id, f.item_id, c.page_id, p.title, p.domain, p.project, p.created_at, c.day, d.page_id IS NOT NULL AS lasting, greatest((epoch(TIMESTAMP '{NOW}') - epoch(p.created_at)) / 86400.0, 0) AS age, f.score AS raw
  FROM pool_ f JOIN c USING (item_id) JOIN pages_ p ON p.page_id = c.page_id LEFT JOIN durable d ON d.page_id = c.page_id),
boosted AS (SELECT k.*, q.is_count, q.mode, q.lim, q.as_of, CASE WHEN q.mode <> 'hybrid' THEN raw ELSE raw * CASE WHEN lasting THEN greatest(exp(-age / 30), 0.5) ELSE exp(-age / 30) END
  * CASE WHEN q.anchor IS NULL THEN 1 ELSE 1 + 4 * exp(-abs(date_diff('day', q.anchor, day)) / 7.0) END END AS score FROM known k JOIN q USING (question_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, item_id) AS rank FROM boosted),
ow AS (SELECT *, is_count AND mode = 'hybrid' AND row_number() OVER (PARTITION BY question_id, page_id ORDER BY rank) > 3 AS over_ FROM rk),
ps AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY over_, rank) AS position FROM ow QUALIFY position <= lim)
SELECT question_id, position, item_id, page_id, round(score, 9) AS score, mode AS source, title, domain, project FROM ps WHERE as_of IS NULL OR created_at <= as_of"""


def corpus(spark, sf_dir) -> search.Corpus:
    p = pages(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 1000).alias("item_id"), F.col("vec_id").alias("page_id"), "embedding")
    day = F.to_date("created_at")
    chunks = p.select("page_id", "created_at", F.inline(ingest.fixed_chunks(F.col("content"))))
    chunks = chunks.select((F.col("page_id") * 1000 + F.col("position")).alias("item_id"), "page_id", "position", F.col("content").alias("text"), F.array(F.date_format(day, "'d'yyyyMMdd")).alias("dates"), day.alias("session_day"))
    n = entities(spark, sf_dir)
    gone = F.when((F.col("kind") == "person") & (F.col("entity_id") % 10 == 3), F.lit("2024-01-31").cast("timestamp"))
    aliases = F.when(F.col("kind") == "place", F.array("name")).otherwise(F.array().cast("array<string>"))
    n = n.select("*", aliases.alias("aliases"), F.lit("1995-01-01").cast("timestamp").alias("valid_from"), gone.alias("valid_to"))
    # several channels and their hops read the edges, which a join and a grouping make
    e = cut_round(edges(spark, sf_dir))
    lasting = F.col("from_id").between(PART + 1, PART + 20) | F.col("to_id").between(PART + 1, PART + 20)
    durable = current(e).filter(F.col("page_id").isNotNull() & lasting).select("page_id")
    return search.Corpus(chunks, p.select("page_id", "domain", "project", "title", "created_at"), n, e, durable, WALKED, HUB, vectors=vectors)


def asked(spark, sf_dir):
    rows = spark.createDataFrame([r[:9] for r in ASKED], "question_id int, text string, terms string, vec_id long, mode string, domain string, project string, as_of string, limit int")
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("qvec"))
    return v.join(F.broadcast(rows), "vec_id", "right").withColumn("as_of", F.col("as_of").cast("timestamp")).withColumn("now", F.lit(NOW).cast("timestamp"))


def _shown(df):
    return df.select("question_id", "position", "item_id", "page_id", F.round("score", 9).alias("score"), "source", "title", "domain", "project")


@query(_search_sql(search.CHANNELS))
def hybrid_five(spark, sf_dir):
    return _shown(search.search(asked(spark, sf_dir), corpus(spark, sf_dir)))


@query(_search_sql([c for c in search.CHANNELS if c not in ("vector", "date")]))
def hybrid_degraded(spark, sf_dir):
    """A provider that fails when it is asked, and one whose table is missing: the other channels answer."""

    def broken(own, at):
        return own.select("question_id", F.raise_error(F.lit("no embedder")).cast("long").alias("item_id"), F.lit(1).alias("rank"))

    def missing(own, at):
        return table(spark, sf_dir, "no_such_table")

    return _shown(search.search(asked(spark, sf_dir), corpus(spark, sf_dir), run={"vector": broken, "date": missing}))


@query(_found_sql(["entity"]) + " SELECT question_id, item_id, rank FROM found")
def entity_match_alias(spark, sf_dir):
    found = search.channels(search.pooled(asked(spark, sf_dir)), corpus(spark, sf_dir), ("entity",))
    return found.select("question_id", "item_id", "rank")


_ASKED_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(q.text), '[^\p{L}\p{N}]+'), lambda w: w <> ''))"
_OWN_WORDS = r"list_filter(regexp_split_to_array(lower(c.text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(_found_sql(["entity", "graph"]) + f""", s AS (SELECT f.question_id, f.item_id, len(list_intersect({_ASKED_WORDS}, {_OWN_WORDS}))::DOUBLE / len({_ASKED_WORDS}) AS s FROM found f JOIN q USING (question_id) JOIN c ON c.item_id = f.item_id WHERE channel = 'graph' AND c.text <> '')
SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, item_id) AS rank FROM s""")
def graph_rerank(spark, sf_dir):
    """The graph's channel in a reranker's order, as it enters the fusion."""
    from ..operators import retrieval

    return search.channels(search.pooled(asked(spark, sf_dir)), corpus(spark, sf_dir), ("graph",), rerank=retrieval.overlap).select("question_id", "item_id", "rank")
