"""Retrieval: channels, fusion, boosts and selections over a table of questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, scores
from ..operators import ranking, retrieval
from ..operators.degrees import Degrees
from ..operators.state import shared_dir
from ..sources.tables import EDGES_SQL, ENTITIES_SQL, edges, entities, hours_after_start, pages, table
from .base import SQL, query

#: Probe questions: number, terms, a vector by its id, a project.
QUESTIONS = [(1, "the and", 3, None), (2, "de la", 17, "fr"), (3, "und der", 42, None), (4, "with that", 99, "en"), (5, "los que", 256, "es")]
_VALUES = ", ".join(f"({i}, '{t}', {v}, {'NULL' if p is None else repr(p)})" for i, t, v, p in QUESTIONS)
Q_SQL = f"q AS (SELECT * FROM (VALUES {_VALUES}) AS v(question_id, terms, vec_id, project))"
NAMES = [(1, "Customer#000000012"), (2, "Supplier#000000003"), (3, "JAPAN EUROPE"), (4, "customer 000000077 nation")]
_NAMES = ", ".join(f"({i}, '{t}')" for i, t in NAMES)
N_SQL = f"nq AS (SELECT * FROM (VALUES {_NAMES}) AS v(question_id, text))"
TOP = 10
POOL = 50


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id int, terms string, vec_id long, project string")


def named(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMES, "question_id int, text string")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select(F.col("item_id").alias("vec_id"), F.col("embedding").alias("qvec"))
    return v.join(F.broadcast(questions(spark)), "vec_id").select("question_id", "qvec")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


VEC_SQL = """vec AS (SELECT question_id, item_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY round(distance, 9), item_id) AS rank FROM (
  SELECT q.question_id, e.vec_id AS item_id, 1 - list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))) AS distance
  FROM q JOIN embeddings p ON p.vec_id = q.vec_id CROSS JOIN embeddings e) WHERE distance <= 1.0 QUALIFY rank <= 50)"""
FTS_SQL = r"""tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM documents),
sz AS (SELECT doc_id, count(*) AS size FROM tok GROUP BY doc_id),
asked AS (SELECT DISTINCT question_id, unnest(string_split(terms, ' ')) AS term FROM q),
hit AS (SELECT a.question_id, t.doc_id, a.term, count(*) AS tf FROM asked a JOIN tok t ON t.term = a.term GROUP BY ALL),
fts AS (SELECT question_id, doc_id AS item_id, round(sum((1 + ln(tf)) / (1 + ln(size))), 9) AS fts FROM hit JOIN sz USING (doc_id)
  GROUP BY question_id, doc_id HAVING count(*) = (SELECT count(*) FROM asked a WHERE a.question_id = hit.question_id)),
ftr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fts DESC, item_id) AS rank FROM fts QUALIFY rank <= 50)"""
FUSED_SQL = """ch AS (SELECT question_id, item_id, 'vector' AS channel, rank, 1.0 AS weight FROM vec UNION ALL SELECT question_id, item_id, 'fts', rank, 1.0 FROM ftr),
fused AS (SELECT question_id, item_id, sum(weight::DOUBLE / (60 + rank)) AS score FROM ch GROUP BY ALL),
ord AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, item_id) AS rank FROM fused)"""
BASE = f"WITH {Q_SQL}, {VEC_SQL}, {FTS_SQL}, {FUSED_SQL}"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = retrieval.vector_channel(probe(spark, sf_dir), vectors(spark, sf_dir), POOL)
    t = retrieval.keyword_channel(questions(spark), texts(spark, sf_dir), POOL)
    return retrieval.channel(v, "vector").unionByName(retrieval.channel(t, "fts"))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(ranking.fuse(channels(spark, sf_dir), ["question_id"], "item_id"), ["question_id"], [F.round("score", 12).desc(), F.col("item_id")])


@query(f"WITH {Q_SQL}, {VEC_SQL} SELECT question_id, item_id, round(distance, 6) + 0.0::DOUBLE AS distance, rank FROM vec WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    near = retrieval.vector_channel(probe(spark, sf_dir), vectors(spark, sf_dir), TOP)
    return near.select("question_id", "item_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), "rank")


@query(f"""WITH {Q_SQL} SELECT q.question_id, count(*) FILTER (d <= 0.5) AS near, count(*) FILTER (d <= 1.0) AS gated, count(*) AS n FROM (
  SELECT q.question_id, list_cosine_distance(e.embedding, p.embedding) AS d FROM q JOIN embeddings p ON p.vec_id = q.vec_id CROSS JOIN embeddings e) q GROUP BY q.question_id""")
def vector_gate(spark, sf_dir):
    d = scores.cosine_distance(F.col("qvec"), F.col("embedding"))
    all_of = vectors(spark, sf_dir).join(F.broadcast(probe(spark, sf_dir)), F.size("qvec") == F.size("embedding"))
    return all_of.groupBy("question_id").agg(F.count_if(d <= 0.5).alias("near"), F.count_if(d <= 1.0).alias("gated"), F.count("*").alias("n"))


@query(f"WITH {Q_SQL}, {FTS_SQL} SELECT question_id, item_id, round(fts, 6) AS fts, rank FROM ftr WHERE rank <= 10")
def fts_simple_topk(spark, sf_dir):
    hit = retrieval.keyword_channel(questions(spark), texts(spark, sf_dir), TOP)
    return hit.select("question_id", "item_id", F.round("fts", 6).alias("fts"), "rank")


@query()
def fts_english_topk(spark, sf_dir):
    from ..functions.stem import stemmed, stemmed_texts

    q = questions(spark).withColumn("terms", F.array_join(stemmed(F.col("terms")), " "))
    return retrieval.keyword_channel(q, stemmed_texts(texts(spark, sf_dir)), TOP).select("question_id", "item_id", F.round("fts", 6).alias("fts"), "rank")


@query(f"{BASE} SELECT question_id, item_id, round(score, 9) AS score, rank FROM ord")
def rrf_weighted(spark, sf_dir):
    return fused(spark, sf_dir).select("question_id", "item_id", F.round("score", 9).alias("score"), "rank")


@query(f"""{BASE} SELECT question_id, item_id, round(score, 9) AS score, rank, lang, source, n_chars FROM ord LEFT JOIN documents ON doc_id = item_id WHERE rank <= 10""")
def hybrid_search(spark, sf_dir):
    best = fused(spark, sf_dir).filter(F.col("rank") <= TOP)
    # text columns are read only for what is returned
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source", "n_chars")
    return docs.join(F.broadcast(best), "item_id", "right").select("question_id", "item_id", F.round("score", 9).alias("score"), "rank", "lang", "source", "n_chars")


@query(f"""{BASE} SELECT question_id, item_id, round(score, 9) AS score, rank, 'Doc ' || doc_id || ': ' || substr(text, 1, 12) AS title, source AS domain,
  CASE WHEN doc_id % 4 <> 0 THEN lang END AS project, substr(text, 1, 80) AS preview FROM ord JOIN documents ON doc_id = item_id WHERE rank <= 10""")
def hydrate_results(spark, sf_dir):
    best = fused(spark, sf_dir).filter(F.col("rank") <= TOP)
    p = pages(spark, sf_dir).select(F.col("page_id").alias("item_id"), "title", "domain", "project", F.substring("content", 1, 80).alias("preview"))
    return p.join(F.broadcast(best), "item_id").select("question_id", "item_id", F.round("score", 9).alias("score"), "rank", "title", "domain", "project", "preview")


@query(f"""{BASE}, r AS (SELECT question_id, item_id, score * CASE WHEN item_id % 5 = 0 THEN greatest(exp(-greatest(age, 0) / 30), 0.5) ELSE exp(-greatest(age, 0) / 30) END AS score
  FROM (SELECT *, (epoch(TIMESTAMP '2024-02-01') - epoch(TIMESTAMP '2024-01-01' + to_hours(item_id::INT))) / 86400.0 AS age FROM ord))
SELECT question_id, item_id, round(score, 9) AS score FROM r""")
def recency_boost(spark, sf_dir):
    age = (F.lit(1706745600) - F.unix_seconds(hours_after_start(F.col("item_id")))) / 86400.0
    return fused(spark, sf_dir).select("question_id", "item_id", F.round(scores.recency(F.col("score"), age, F.col("item_id") % 5 == 0), 9).alias("score"))


@query(f"""{BASE} SELECT question_id, item_id, round(score * CASE WHEN item_id % 3 = 0 THEN 1 ELSE 1 + 4 * exp(-abs(date_diff('day', DATE '2024-01-10', DATE '2024-01-01' + (item_id // 24)::INT)) / 7.0) END, 9) AS score FROM ord""")
def date_anchor_boost(spark, sf_dir):
    day = F.when(F.col("item_id") % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") / 24).cast("int")))
    return fused(spark, sf_dir).select("question_id", "item_id", F.round(scores.anchored(F.col("score"), F.datediff(day, F.lit("2024-01-10"))), 9).alias("score"))


@query(f"""WITH {EDGES_SQL} SELECT DISTINCT page_id FROM edges WHERE page_id IS NOT NULL AND valid_to IS NULL AND (from_id - 5000000000 BETWEEN 1 AND 20 OR to_id - 5000000000 BETWEEN 1 AND 20)""")
def recency_exempt(spark, sf_dir):
    from ..operators.graph import endpoints
    from ..sources.tables import PART, current

    lasting = F.col("entity_id").between(PART + 1, PART + 20)
    return endpoints(current(edges(spark, sf_dir)).filter("page_id is not null")).filter(lasting).select("page_id").distinct()


_SEL = f"{BASE}, s AS (SELECT question_id, item_id, score, rank, item_id % 7 AS page FROM ord)"


def selected(spark, sf_dir):
    return fused(spark, sf_dir).withColumn("page", F.col("item_id") % 7)


@query(f"""{_SEL}, o AS (SELECT *, row_number() OVER (PARTITION BY question_id, page ORDER BY rank) AS own FROM s)
SELECT question_id, item_id, page, row_number() OVER (PARTITION BY question_id ORDER BY own > 3, rank) AS position FROM o QUALIFY position <= 24""")
def cap_per_page(spark, sf_dir):
    return ranking.cap_with_backfill(selected(spark, sf_dir), ["question_id"], "page", 3, 24).select("question_id", "item_id", "page", "position")


@query(f"{_SEL} SELECT question_id, item_id, page, rank FROM s QUALIFY row_number() OVER (PARTITION BY question_id, page ORDER BY rank) <= 2")
def hard_cap_per_page(spark, sf_dir):
    return ranking.hard_cap(selected(spark, sf_dir), ["question_id"], "page", 2).select("question_id", "item_id", "page", "rank")


_NDCG = f"""{_SEL}, o AS (SELECT *, row_number() OVER (PARTITION BY question_id, page ORDER BY rank) AS own FROM s),
g AS (SELECT question_id, page, sum(score / log2(own + 1)) AS gain, min(rank) AS first FROM o GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY gain DESC, first) AS page_rank FROM g)"""


@query(f"{_NDCG} SELECT question_id, page, round(gain, 9) AS gain, page_rank FROM gr")
def session_ndcg(spark, sf_dir):
    return ranking.session_gain(selected(spark, sf_dir), ["question_id"], "page").select("question_id", "page", F.round("gain", 9).alias("gain"), "page_rank")


@query(f"""{_NDCG} SELECT question_id, item_id, row_number() OVER (PARTITION BY question_id ORDER BY own, page_rank) AS position
FROM o JOIN gr USING (question_id, page) WHERE page_rank <= 4 QUALIFY position <= 15""")
def session_round_robin(spark, sf_dir):
    return ranking.round_robin(selected(spark, sf_dir), ["question_id"], "page", 4, 15).select("question_id", "item_id", "position")


@query(f"""{BASE}, k AS (SELECT DISTINCT c.question_id, c.item_id, channel FROM ch c JOIN ord o ON o.question_id = c.question_id AND o.item_id = c.item_id WHERE o.rank <= 10)
SELECT channel, count(*) AS covers, count(*) FILTER (n = 1) AS exclusive FROM (SELECT *, count(*) OVER (PARTITION BY question_id, item_id) AS n FROM k) GROUP BY channel""")
def channel_contribution(spark, sf_dir):
    every = channels(spark, sf_dir)
    best = ranking.ranked(ranking.fuse(every, ["question_id"], "item_id"), ["question_id"], [F.round("score", 12).desc(), F.col("item_id")]).filter(F.col("rank") <= TOP)
    return ranking.contribution(every, best, ["question_id"], "item_id")


@query(f"""WITH {Q_SQL}, {FTS_SQL}, m AS (SELECT item_id, question_id AS part, rank, row_number() OVER (PARTITION BY item_id ORDER BY question_id, rank) AS own FROM ftr)
SELECT item_id, part, row_number() OVER (ORDER BY part, rank) AS position FROM m WHERE own = 1 QUALIFY position <= 40""")
def multihop_union(spark, sf_dir):
    # the questions as one question's parts, in order
    parts = retrieval.keyword_channel(questions(spark), texts(spark, sf_dir), POOL).select(F.lit(0).alias("whole"), F.col("question_id").alias("part"), "item_id", "rank")
    return ranking.first_seen(parts, ["whole"], "item_id", ["part", "rank"]).filter("position <= 40").select("item_id", "part", "position")


@query(f"""{BASE}, h AS (SELECT o.question_id, o.item_id, o.rank, len(list_intersect(list_distinct(string_split(q.terms, ' ')), list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')))::DOUBLE / len(list_distinct(string_split(q.terms, ' '))) AS rerank
  FROM ord o JOIN q USING (question_id) LEFT JOIN documents ON doc_id = item_id WHERE o.rank <= 64)
SELECT question_id, item_id, round(rerank, 6) AS rerank, row_number() OVER (PARTITION BY question_id ORDER BY rerank DESC, rank) AS position FROM h QUALIFY position <= 10""")
def rerank_overlap(spark, sf_dir):
    q = questions(spark).select("question_id", "terms")
    pool = fused(spark, sf_dir).filter("rank <= 64").join(F.broadcast(q), "question_id")
    full = texts(spark, sf_dir).join(F.broadcast(pool), "item_id", "right").withColumn("text", F.coalesce("text", F.lit("")))
    return retrieval.rerank(full, retrieval.overlap(F.col("terms"), F.col("text")), 64, TOP).select("question_id", "item_id", F.round("rerank", 6).alias("rerank"), "position")


TRI_SQL = r"""w AS (SELECT key, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM names),
tg AS (SELECT DISTINCT key, substr('  ' || word || ' ', i, 3) AS g FROM (SELECT key, word, unnest(range(1, length(word) + 2)) AS i FROM w)),
tn AS (SELECT key, count(*) AS n FROM tg GROUP BY key)"""
SEED_SQL = f"""names AS (SELECT 'q' || question_id AS key, text FROM nq UNION ALL SELECT 'e' || entity_id, name FROM entities), {TRI_SQL},
sim AS (SELECT substr(a.key, 2)::INT AS question_id, substr(b.key, 2)::BIGINT AS entity_id, round(count(*)::DOUBLE / (min(x.n) + min(y.n) - count(*)), 9) AS sim
  FROM tg a JOIN tg b ON a.g = b.g JOIN tn x ON x.key = a.key JOIN tn y ON y.key = b.key WHERE a.key[1] = 'q' AND b.key[1] = 'e' GROUP BY a.key, b.key),
seed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, entity_id) AS seed_rank FROM sim WHERE sim >= 0.3)"""
DEG_SQL = "deg AS (SELECT entity_id, count(*) AS degree FROM (SELECT from_id AS entity_id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY entity_id)"


@query(f"""WITH {N_SQL}, {ENTITIES_SQL}, {EDGES_SQL}, {SEED_SQL}, {DEG_SQL},
f AS (SELECT question_id, entity_id, sim / (1 + 0.001 * pow(greatest(coalesce(degree, 0) - 1, 0), 2)) AS w FROM seed LEFT JOIN deg USING (entity_id) WHERE seed_rank <= 8),
p AS (SELECT question_id, page_id, round(sum(w), 6) AS weight FROM f JOIN edges e ON f.entity_id = e.from_id OR f.entity_id = e.to_id WHERE page_id IS NOT NULL GROUP BY ALL)
SELECT question_id, page_id, round(weight, 6) AS weight, row_number() OVER (PARTITION BY question_id ORDER BY weight DESC, page_id) AS rank FROM p QUALIFY rank <= 50""")
def entity_match(spark, sf_dir):
    found = retrieval.entity_channel(named(spark), entities(spark, sf_dir), edges(spark, sf_dir), POOL)
    return found.select("question_id", "page_id", F.round("weight", 6).alias("weight"), "rank")


@query(SQL["entity_match"])
def entity_match_kept(spark, sf_dir):
    """The same with degrees from a kept table: nothing is recounted."""
    e = edges(spark, sf_dir)
    kept = Degrees.start(e, f"{shared_dir(spark)}/degrees-{uuid.uuid4().hex}")
    found = retrieval.entity_channel(named(spark), entities(spark, sf_dir), e, POOL, degrees=kept.read())
    return found.select("question_id", "page_id", F.round("weight", 6).alias("weight"), "rank")


@query(f"""WITH {N_SQL}, {ENTITIES_SQL}, {EDGES_SQL}, {SEED_SQL}, {DEG_SQL},
sure AS (SELECT from_id, to_id, confidence FROM edges WHERE confidence >= 0.5 AND kind IN ('depends_on', 'located_in')),
bi AS (SELECT from_id, to_id, confidence FROM sure UNION ALL SELECT to_id, from_id, confidence FROM sure),
op AS (SELECT bi.* FROM bi JOIN deg ON deg.entity_id = to_id WHERE degree <= 100),
h0 AS (SELECT question_id, entity_id, sim AS mult FROM seed WHERE seed_rank <= 5),
h1 AS (SELECT question_id, to_id AS entity_id, mult * confidence * 0.5 AS mult, h0.entity_id AS a FROM h0 JOIN op ON from_id = h0.entity_id WHERE to_id <> h0.entity_id),
h2 AS (SELECT question_id, to_id AS entity_id, mult * confidence * 0.5 AS mult FROM h1 JOIN op ON from_id = h1.entity_id WHERE to_id <> h1.entity_id AND to_id <> a),
best AS (SELECT question_id, entity_id, max(mult) AS mult FROM (SELECT question_id, entity_id, mult FROM h0 UNION ALL SELECT question_id, entity_id, mult FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL),
p AS (SELECT question_id, page_id, round(sum(mult), 6) AS weight FROM best f JOIN (SELECT from_id AS entity_id, page_id FROM edges WHERE page_id IS NOT NULL UNION ALL SELECT to_id, page_id FROM edges WHERE page_id IS NOT NULL) e USING (entity_id) GROUP BY ALL)
SELECT question_id, page_id, round(weight, 6) AS weight, row_number() OVER (PARTITION BY question_id ORDER BY weight DESC, page_id) AS rank FROM p QUALIFY rank <= 50""")
def graph_expansion(spark, sf_dir):
    found = retrieval.expansion_channel(named(spark), entities(spark, sf_dir), edges(spark, sf_dir), POOL, kinds=["depends_on", "located_in"], hub=100)
    return found.select("question_id", "page_id", F.round("weight", 6).alias("weight"), "rank")


@query(f"""WITH {N_SQL}, {ENTITIES_SQL}, {SEED_SQL} SELECT question_id, entity_id, round(sim, 6) AS sim FROM seed WHERE seed_rank = 1""")
def resolve_entity(spark, sf_dir):
    return retrieval.seeds(named(spark), entities(spark, sf_dir), 1).select("question_id", "entity_id", F.round("sim", 6).alias("sim"))


@query(r"""WITH t AS (SELECT o_orderkey AS item_id, 'Session on ' || CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 3 THEN strftime(o_orderdate, '%-d %B %Y') ELSE 'no date' END AS text, o_orderdate::DATE AS day FROM orders),
q AS (SELECT * FROM (VALUES (1, DATE '1996-03-13'), (2, DATE '1997-08-05'), (3, DATE '1999-12-01')) v(question_id, day))
SELECT question_id, item_id, 1 AS shared, row_number() OVER (PARTITION BY question_id ORDER BY item_id) AS rank FROM t JOIN q USING (day) WHERE item_id % 5 <> 4 QUALIFY rank <= 20""")
def date_search(spark, sf_dir):
    from .dating import dated_text

    q = spark.createDataFrame([(1, "what happened on 13/03/1996?"), (2, "[Today: 2001/01/01] and on August 5, 1997"), (3, "em 1 de dezembro de 1999")], "question_id int, text string")
    q = q.select("question_id", dates.date_tokens(dates.strip_context_date(F.col("text"))).alias("tokens"))
    t = dated_text(spark, sf_dir).select("item_id", dates.date_tokens(F.col("text")).alias("tokens"))
    return retrieval.date_channel(q, t, 20).select("question_id", "item_id", F.col("shared").cast("int").alias("shared"), "rank")


@query(f"""{BASE} SELECT question_id, item_id, round(1.0 / rank, 9) AS score FROM vec WHERE rank <= 10""")
def rank_reciprocal(spark, sf_dir):
    near = retrieval.vector_channel(probe(spark, sf_dir), vectors(spark, sf_dir), TOP)
    return near.select("question_id", "item_id", F.round(1.0 / F.col("rank"), 9).alias("score"))


@query(f"""{_SEL} SELECT question_id, page, item_id FROM s QUALIFY row_number() OVER (PARTITION BY question_id, page ORDER BY rank) = 1""")
def source_dedup_by_page(spark, sf_dir):
    return ranking.hard_cap(selected(spark, sf_dir), ["question_id"], "page", 1).select("question_id", "page", "item_id")


@query(f"""{_SEL}, g AS (SELECT question_id, page, min(rank) AS first FROM s GROUP BY ALL) SELECT question_id, page, row_number() OVER (PARTITION BY question_id ORDER BY first) AS position FROM g""")
def group_first_seen(spark, sf_dir):
    g = selected(spark, sf_dir).groupBy("question_id", "page").agg(F.min("rank").alias("first"))
    return ranking.ranked(g, ["question_id"], [F.col("first")], "position").select("question_id", "page", "position")


@query("""SELECT lang AS project, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 3 AS batch FROM documents""")
def batch_of_three(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("project"), "doc_id")
    return ranking.ranked(d, ["project"], [F.col("doc_id")], "r").select("project", "doc_id", F.expr("(r - 1) div 3").alias("batch"))


@query(f"""WITH s AS (SELECT conv_id, turn, 1.0 / (1 + turn) AS score, row_number() OVER (ORDER BY turn, conv_id) AS rank FROM conversations WHERE role = 'user'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS own FROM s), g AS (SELECT conv_id, sum(score / log2(own + 1)) AS gain, min(rank) AS first FROM o GROUP BY conv_id),
gr AS (SELECT *, row_number() OVER (ORDER BY round(gain, 9) DESC, first) AS page_rank FROM g)
SELECT conv_id, turn, row_number() OVER (ORDER BY own, page_rank) AS position FROM o JOIN gr USING (conv_id) WHERE page_rank <= 8 QUALIFY position <= 40""")
def session_select_count(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.lit(0).alias("question_id"), "conv_id", "turn", (1.0 / (1 + F.col("turn"))).alias("score"))
    c = ranking.ranked(c, ["question_id"], [F.col("turn"), F.col("conv_id")])
    best = ranking.session_gain(c, ["question_id"], "conv_id")
    best = ranking.ranked(best.drop("page_rank"), ["question_id"], [F.round("gain", 9).desc(), F.col("first")], "page_rank").filter("page_rank <= 8").select("question_id", "conv_id", "page_rank")
    inner = ranking.ranked(c, ["question_id", "conv_id"], [F.col("rank")], "own").join(F.broadcast(best), ["question_id", "conv_id"])
    return ranking.top_k(inner, ["question_id"], [F.col("own"), F.col("page_rank")], 40, "position").select("conv_id", "turn", "position")


@query(f"""{_SEL}, best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id, page ORDER BY rank) = 1),
pin AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE source = 'src5' AND doc_id % 4 = 0 QUALIFY r <= 3),
o AS (SELECT question_id, 'guideline' AS part, r AS position, doc_id AS item_id, text FROM pin, q UNION ALL SELECT question_id, 'source', row_number() OVER (PARTITION BY question_id ORDER BY rank), item_id, text FROM best LEFT JOIN documents ON doc_id = item_id),
h AS (SELECT *, substr(text, 1, 400) AS head FROM o), w AS (SELECT *, regexp_extract(head, '(?s)^(.*) [^ ]*$', 1) AS whole FROM h)
SELECT question_id, part, position, item_id, CASE WHEN length(text) <= 400 THEN text WHEN length(whole) > 200 THEN whole || '…' ELSE head || '…' END AS snippet FROM w""")
def search_sources(spark, sf_dir):
    from ..functions.text import snippet

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    pinned = table(spark, sf_dir, "documents").filter("source = 'src5' AND doc_id % 4 = 0").select(F.col("doc_id").alias("item_id"), "text").orderBy("item_id").limit(3)
    pinned = ranking.ranked(pinned.withColumn("_", F.lit(0)), ["_"], [F.col("item_id")], "position").join(F.broadcast(questions(spark).select("question_id")), F.lit(True))
    best = ranking.hard_cap(selected(spark, sf_dir), ["question_id"], "page", 1)
    best = ranking.ranked(best, ["question_id"], [F.col("rank")], "position").select("question_id", "item_id", "position")
    full = d.join(F.broadcast(best), "item_id", "right")
    shown = lambda df, part: df.select("question_id", F.lit(part).alias("part"), "position", "item_id", snippet(F.col("text")).alias("snippet"))
    return shown(pinned, "guideline").unionByName(shown(full, "source"))
