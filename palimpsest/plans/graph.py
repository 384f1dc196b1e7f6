"""The entity graph: normalisation, degrees, overviews, traversal, history and resolution."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import kinds, scores, text
from ..operators import degrees, graph, intervals, resolve, retrieval
from ..operators.joins import meet
from ..operators.ranking import page, top_k
from ..operators.state import cut_round, shared_dir
from ..sources.tables import EDGES_SQL, ENTITIES_SQL, NATION, PART, PERSON, as_of, current, edges, entities, table
from .base import query

_E = f"WITH {ENTITIES_SQL}, {EDGES_SQL}"
_ENDS = "ends AS (SELECT from_id AS entity_id, to_id AS other, kind, page_id FROM edges UNION ALL SELECT to_id, from_id, kind, page_id FROM edges)"
_DEG = "deg AS (SELECT entity_id, count(*) AS degree FROM ends GROUP BY 1)"
_KINDS = ["uses", " Used_In ", "IS_A", "hosts", "", "relates_to", "depends_on", "requires", "verifies_quota", "owned_by", "related_to", "merged_into", "scheduled_for", "Fixed"]
_CANON = ["uses", "uses", "part_of", "relates_to", "relates_to", "relates_to", "depends_on", "depends_on", "validates", "owned_by", "relates_to", "replaces", "happened_at", "fixes"]


@query("SELECT o_orderkey, " + "CASE o_orderkey % 14 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_CANON)) + " END AS kind FROM orders")
def edge_kind_normalize(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 14 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", kinds.edge_kind(raw).alias("kind"))


@query("""WITH x AS (SELECT event_id, ['extracted', 'INFERRED', 'ambiguous', 'guess', ''][(event_id % 5 + 1)::INT] AS state, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN value - 50 ELSE value END AS score FROM events)
SELECT event_id, CASE WHEN lower(state) IN ('extracted', 'inferred', 'ambiguous') THEN lower(state) ELSE 'extracted' END AS confidence,
round(CASE WHEN coalesce(score, 0) <= 0 THEN CASE lower(state) WHEN 'inferred' THEN 0.7 WHEN 'ambiguous' THEN 0.4 ELSE 1.0 END ELSE least(score, 1.0) END, 6)::DOUBLE AS score FROM x""")
def confidence_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.element_at(F.array(*[F.lit(x) for x in ("extracted", "INFERRED", "ambiguous", "guess", "")]), (F.col("event_id") % 5 + 1).cast("int"))
    k = F.col("event_id") % 3
    found = scores.confidence(state, F.when(k == 1, F.col("value") - 50).when(k == 2, F.col("value")))
    return e.select("event_id", found["state"].alias("confidence"), F.round(found["score"], 6).alias("score"))


@query("""WITH e AS (SELECT c_custkey AS id, trim(c_name) AS name, lower(c_mktsegment) AS kind FROM customer WHERE c_custkey % 4 <> 0),
n AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, id FROM e),
r AS (SELECT o_orderkey, o_custkey AS a, o_custkey % 100 + 1 AS b FROM orders)
SELECT o_orderkey, a, b, 'relates_to' AS kind, 1.0::DOUBLE AS weight FROM r WHERE a <> b AND a IN (SELECT id FROM e) AND b IN (SELECT id FROM e)""")
def sanitize_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"))
    known = resolve.sanitize_entities(c).select("id")
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") % 100 + 1).alias("b"), F.lit("no such kind").alias("kind"), F.lit(None).cast("double").alias("weight"))
    return resolve.sanitize_edges(raw, known)


@query(f"{_E}, {_ENDS}, {_DEG} SELECT * FROM deg")
def degree(spark, sf_dir):
    return graph.degree(edges(spark, sf_dir))


@query(f"{_E} SELECT kind, count(*) AS n FROM entities GROUP BY kind")
def graph_by_kind(spark, sf_dir):
    return entities(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"{_E}, {_ENDS}, {_DEG} SELECT entity_id, name, degree FROM deg JOIN entities USING (entity_id) ORDER BY degree DESC, entity_id LIMIT 10")
def graph_central(spark, sf_dir):
    top = graph.degree(edges(spark, sf_dir)).orderBy(F.desc("degree"), "entity_id").limit(10)
    return entities(spark, sf_dir).join(F.broadcast(top), "entity_id").select("entity_id", "name", "degree")


@query(f"""{_E}, {_ENDS}, c AS (SELECT entity_id, count(*) AS degree, count(DISTINCT kind) AS kinds FROM ends GROUP BY 1 HAVING count(*) >= 3)
SELECT entity_id, name, kinds, degree FROM c JOIN entities USING (entity_id) ORDER BY kinds DESC, degree DESC, entity_id LIMIT 10""")
def graph_connectors(spark, sf_dir):
    d = graph.endpoints(edges(spark, sf_dir).select("from_id", "to_id", "kind")).groupBy("entity_id").agg(F.count("*").alias("degree"), F.count_distinct("kind").alias("kinds"))
    top = d.filter("degree >= 3").orderBy(F.desc("kinds"), F.desc("degree"), "entity_id").limit(10)
    return entities(spark, sf_dir).join(F.broadcast(top), "entity_id").select("entity_id", "name", "kinds", "degree")


@query(f"""{_E}, {_ENDS}, {_DEG}, top AS (SELECT entity_id FROM deg ORDER BY degree DESC, entity_id LIMIT 150)
SELECT DISTINCT from_id, to_id, kind FROM edges WHERE from_id IN (FROM top) AND to_id IN (FROM top) AND from_id <> to_id""")
def graph_subgraph(spark, sf_dir):
    e = edges(spark, sf_dir)
    top = F.broadcast(graph.degree(e).orderBy(F.desc("degree"), "entity_id").limit(150).select("entity_id"))
    inner = e.join(top, e.from_id == top.entity_id, "left_semi").join(top, F.col("to_id") == top.entity_id, "left_semi")
    return inner.filter("from_id <> to_id").select("from_id", "to_id", "kind").distinct()


@query(f"{_E}, {_ENDS} SELECT DISTINCT entity_id, page_id FROM ends WHERE entity_id BETWEEN {PART + 1} AND {PART + 30} AND page_id IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY entity_id ORDER BY page_id DESC) <= 20")
def entity_pages(spark, sf_dir):
    from ..operators.ranking import page, top_k

    e = graph.endpoints(edges(spark, sf_dir).filter("page_id IS NOT NULL").select("from_id", "to_id", "page_id")).filter(F.col("entity_id").between(PART + 1, PART + 30))
    return top_k(e.select("entity_id", "page_id").distinct(), ["entity_id"], [F.desc("page_id")], 20).drop("rank")


@query(f"""{_E}, f AS (SELECT entity_id, name, kind, row_number() OVER (ORDER BY kind, name, entity_id) AS position, count(*) OVER () AS total FROM entities WHERE name ILIKE '%er#0000000%' AND kind IN ('person', 'organization'))
SELECT *, total > 25 AS has_more FROM f WHERE position BETWEEN 6 AND 25""")
def entities_list(spark, sf_dir):
    found = entities(spark, sf_dir).filter(F.col("name").ilike("%er#0000000%") & F.col("kind").isin("person", "organization"))
    return page(found.select("entity_id", "name", "kind"), [F.col("kind"), F.col("name"), F.col("entity_id")], 20, 5)


def _seeds(spark):
    return spark.createDataFrame([(PERSON + i,) for i in (1, 2, 5, 10)], "seed_id long")


def _walk(depth: int, where: str = "", cap: int = 100) -> str:
    return f"""{_E}, w AS (SELECT from_id, to_id, kind, max(confidence) AS weight FROM edges {where} GROUP BY ALL),
    s AS (SELECT unnest([{', '.join(str(PERSON + i) for i in (1, 2, 5, 10))}]) AS seed_id),
    """ + ", ".join(
        ["p1 AS (SELECT seed_id, to_id AS entity_id, kind AS edge_kind, weight, 1 AS depth, [seed_id, to_id] AS path FROM s JOIN w ON from_id = seed_id)"]
        + [f"p{d} AS (SELECT seed_id, to_id AS entity_id, w.kind AS edge_kind, w.weight, {d} AS depth, list_append(path, to_id) AS path FROM b{d - 1} p JOIN w ON from_id = p.entity_id WHERE NOT list_contains(path, to_id) AND NOT EXISTS (SELECT 1 FROM ("
           + " UNION ALL ".join(f"SELECT seed_id, entity_id FROM b{k}" for k in range(1, d)) + f""") o WHERE o.seed_id = p.seed_id AND o.entity_id = to_id)),
        b{d} AS (SELECT * FROM p{d} QUALIFY row_number() OVER (PARTITION BY seed_id, entity_id ORDER BY weight DESC, edge_kind, path) = 1)""" for d in range(2, depth + 1)]
    ).replace(", p2 AS", ", b1 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY seed_id, entity_id ORDER BY weight DESC, edge_kind, path) = 1), p2 AS", 1) + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM b{d}" for d in range(1, depth + 1)) + f"""),
    top AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY depth, entity_id) <= {cap}),
    st AS (SELECT seed_id, entity_id AS found, unnest(path) AS id, generate_subscripts(path, 1) AS k FROM top),
    sl AS (SELECT seed_id, found, string_agg(slug, '>' ORDER BY k) AS slugs FROM st JOIN entities e ON e.entity_id = st.id GROUP BY seed_id, found)
    SELECT top.seed_id, top.entity_id, edge_kind, round(weight, 6) AS weight, depth, array_to_string(path, '>') AS path, slugs FROM top LEFT JOIN sl ON sl.seed_id = top.seed_id AND sl.found = top.entity_id"""


def _hops(spark, sf_dir, e, depth, kinds=None):
    found = graph.traverse(_seeds(spark), e, depth, kinds, entities=entities(spark, sf_dir))
    return found.select("seed_id", "entity_id", "edge_kind", F.round("weight", 6).alias("weight"), "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.array_join("path_slugs", ">").alias("slugs"))


@query(_walk(3))
def traverse_depth(spark, sf_dir):
    return _hops(spark, sf_dir, edges(spark, sf_dir), 3)


@query(_walk(2, "WHERE kind IN ('located_in', 'part_of')"))
def traverse_kinds(spark, sf_dir):
    return _hops(spark, sf_dir, edges(spark, sf_dir), 2, ["located_in", "part_of"])


@query(_walk(2, "WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1997-01-01')"))
def traverse_as_of(spark, sf_dir):
    return _hops(spark, sf_dir, as_of(edges(spark, sf_dir), "1997-01-01"), 2)


@query("""WITH f AS (SELECT o_custkey AS from_id, o_orderkey AS seq, o_orderkey % 3 AS to_id, o_orderdate AS valid_at, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS invalid_at,
  CASE WHEN o_custkey % 2 = 0 THEN 'works_for' ELSE 'uses' END AS kind FROM orders)
SELECT from_id, seq, kind, to_id, coalesce(invalid_at, CASE WHEN kind = 'works_for' THEN
  (SELECT arg_min(g.valid_at, g.seq) FROM f g WHERE g.from_id = f.from_id AND g.kind = f.kind AND g.seq > f.seq AND g.to_id <> f.to_id) END) AS valid_to FROM f""")
def supersede_history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 3).alias("to_id"), F.col("o_orderdate").alias("valid_at"),
                 F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("invalid_at"), F.when(F.col("o_custkey") % 2 == 0, "works_for").otherwise("uses").alias("kind"))
    return graph.supersede(f).select("from_id", "seq", "kind", "to_id", "valid_to")


@query(f"""{_E}, p AS (SELECT p_partkey AS id, p_name AS name FROM part), w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS word FROM p),
t AS (SELECT DISTINCT id, substr('  ' || word || ' ', i, 3) AS g FROM (SELECT id, word, unnest(range(1, length(word) + 2)) AS i FROM w))
SELECT p_partkey AS id, round((SELECT count(*) FROM t JOIN (SELECT DISTINCT g FROM t WHERE id = 1) o USING (g) WHERE t.id = p_partkey)::DOUBLE /
  ((SELECT count(*) FROM t WHERE t.id = p_partkey) + (SELECT count(*) FROM t WHERE id = 1) - (SELECT count(*) FROM t JOIN (SELECT DISTINCT g FROM t WHERE id = 1) o USING (g) WHERE t.id = p_partkey)), 6) AS sim FROM part""")
def trigram_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = F.broadcast(p.filter("p_partkey = 1").select(F.col("p_name").alias("other")))
    return p.join(first, F.lit(True)).select(F.col("p_partkey").alias("id"), F.round(scores.similarity(F.col("p_name"), F.col("other")), 6).alias("sim"))


_NAMES = "names AS (SELECT s_suppkey AS id, 'organization' AS kind, s_name AS name FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'organization', replace(s_name, 'Supplier', 'Suplier') FROM supplier UNION ALL SELECT n_nationkey + 2000000, 'place', n_name FROM nation)"
_TRI = r"""w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: w <> '')) AS word FROM names),
tg AS (SELECT DISTINCT id, substr('  ' || word || ' ', i, 3) AS g FROM (SELECT id, word, unnest(range(1, length(word) + 2)) AS i FROM w)), tn AS (SELECT id, count(*) AS n FROM tg GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM tg a JOIN tg b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT a, b, round(s.n::DOUBLE / (x.n + y.n - s.n), 9) AS sim FROM s JOIN tn x ON x.id = a JOIN tn y ON y.id = b JOIN names p ON p.id = a JOIN names q ON q.id = b
  WHERE p.kind = q.kind AND list_sort(regexp_extract_all(p.name, '\d+')) = list_sort(regexp_extract_all(q.name, '\d+')) AND s.n::DOUBLE / (x.n + y.n - s.n) >= 0.55)"""


def _names(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    one = s.select(F.col("s_suppkey").alias("id"), F.lit("organization").alias("kind"), F.col("s_name").alias("name"))
    two = s.select((F.col("s_suppkey") + 1000000).alias("id"), F.lit("organization").alias("kind"), F.replace("s_name", F.lit("Supplier"), F.lit("Suplier")).alias("name"))
    return one.unionByName(two).unionByName(n.select((F.col("n_nationkey") + 2000000).cast("long").alias("id"), F.lit("place").alias("kind"), F.col("n_name").alias("name")))


@query(f"WITH {_NAMES}, {_TRI} SELECT a, b, round(sim, 6) AS sim FROM pairs")
def trigram_pairs(spark, sf_dir):
    return resolve.similar_pairs(_names(spark, sf_dir), 0.55).select("a", "b", F.round("sim", 6).alias("sim"))


_COMP = f"""WITH RECURSIVE {_NAMES}, {_TRI}, bo AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS id, a AS other FROM bo UNION SELECT r.id, b FROM reach r JOIN bo ON bo.a = r.other)"""


@query(f"{_COMP} SELECT id, min(other) AS label FROM reach GROUP BY id")
def entity_components(spark, sf_dir):
    return graph.least_label(resolve.similar_links(_names(spark, sf_dir), 0.55))


@query(f"""{_COMP}, label AS (SELECT id, min(other) AS label FROM reach GROUP BY id), e AS (SELECT s_suppkey + CASE WHEN l_linenumber > 3 THEN 1000000 ELSE 0 END AS from_id, l_partkey % 50 + 1 AS to_id FROM supplier JOIN lineitem ON l_suppkey = s_suppkey),
deg AS (SELECT x AS id, count(*) AS d FROM (SELECT from_id AS x FROM e UNION ALL SELECT to_id FROM e WHERE to_id <> from_id) GROUP BY x),
canon AS (SELECT id, first_value(id) OVER (PARTITION BY label ORDER BY coalesce(d, 0) DESC, id) AS c FROM label LEFT JOIN deg USING (id)),
m AS (SELECT coalesce(x.c, from_id) AS from_id, coalesce(y.c, to_id) AS to_id FROM e LEFT JOIN canon x ON x.id = from_id LEFT JOIN canon y ON y.id = to_id)
SELECT from_id, to_id, count(*) AS n FROM m WHERE from_id <> to_id GROUP BY ALL""")
def entity_merge(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey")  # noqa: E741
    e = l.select((F.col("l_suppkey") + F.when(F.col("l_linenumber") > 3, 1000000).otherwise(0)).alias("from_id"), (F.col("l_partkey") % 50 + 1).alias("to_id"))
    names = _names(spark, sf_dir)
    _, moved = graph.resolve(names, e, resolve.similar_links(names, 0.55))
    return moved.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_NAMES}, n AS (SELECT id % 1000000 AS k, id, name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM names WHERE kind = 'organization')
SELECT k, (SELECT name FROM n y WHERE y.k = n.k ORDER BY id DESC LIMIT 1) AS name, count(DISTINCT slug) AS n_aliases, string_agg(DISTINCT slug, ',' ORDER BY slug) AS aliases FROM n GROUP BY k""")
def entity_upsert(spark, sf_dir):
    n = _names(spark, sf_dir).filter("kind = 'organization'").select((F.col("id") % 1000000).alias("k"), "id", "name", F.array(text.normalize(F.col("name"))).alias("aliases"))
    merged = resolve.upsert_entities(n, ["k"], "id")
    return merged.select("k", "name", F.size("aliases").cast("long").alias("n_aliases"), F.array_join("aliases", ",").alias("aliases"))


@query("""WITH n AS (SELECT p_partkey, p_name, lower('show me ' || p_name || ' please') AS q FROM part)
SELECT p_partkey FROM n WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split(p_name, ' ')) AS a) WHERE position(lower(a) IN 'i like a ring and a widget') > 0)""")
def alias_semi_join(spark, sf_dir):
    aliases = F.split("p_name", " ")
    q = F.lit("i like a ring and a widget")
    return table(spark, sf_dir, "part").filter(F.exists(aliases, lambda a: F.contains(q, F.lower(a)))).select("p_partkey")


_TEL = f"{_E}, {_ENDS}, {_DEG}"


@query(f"""{_E}, k AS (SELECT kind, count(*) AS n FROM edges GROUP BY kind) SELECT count(*) AS kinds, count(*) FILTER (n = 1) AS singletons, sum(n)::BIGINT AS edges,
round(100.0 * max(n) / sum(n), 4) AS head_percent FROM k""")
def telemetry_vocab(spark, sf_dir):
    k = edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return k.agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum("n").alias("edges"), F.round(100.0 * F.max("n") / F.sum("n"), 4).alias("head_percent"))


@query(f"""{_TEL}, d AS (SELECT coalesce(degree, 0) AS degree FROM entities LEFT JOIN deg USING (entity_id))
SELECT quantile_disc(degree, 0.5) AS p50, quantile_disc(degree, 0.9) AS p90, quantile_disc(degree, 0.99) AS p99, max(degree) AS highest, round(avg(degree), 6) AS mean, count(*) FILTER (degree = 0) AS none FROM d""")
def telemetry_degree_dist(spark, sf_dir):
    d = entities(spark, sf_dir).select("entity_id").join(graph.degree(edges(spark, sf_dir)), "entity_id", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY degree)")
    return d.agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("degree").alias("highest"), F.round(F.avg("degree"), 6).alias("mean"), F.count_if(F.col("degree") == 0).alias("none"))


@query(f"{_TEL} SELECT kind, count(*) AS orphans FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM ends WHERE kind = 'uses') GROUP BY kind")
def telemetry_orphans(spark, sf_dir):
    used = graph.degree(edges(spark, sf_dir).filter("kind = 'uses'"))
    return entities(spark, sf_dir).join(used, "entity_id", "left_anti").groupBy("kind").agg(F.count("*").alias("orphans"))


@query(f"""{_E} SELECT a.kind AS from_kind, e.kind AS kind, b.kind AS to_kind, count(*) AS n, count(e.page_id) AS with_page FROM edges e LEFT JOIN entities a ON a.entity_id = from_id LEFT JOIN entities b ON b.entity_id = to_id
GROUP BY ALL HAVING count(*) > 1""")
def telemetry_coverage(spark, sf_dir):
    n = entities(spark, sf_dir).select("entity_id", "kind")
    e = cut_round(current(edges(spark, sf_dir)).select("from_id", "to_id", "kind", "page_id"))
    a, b = n.select(F.col("entity_id").alias("from_id"), F.col("kind").alias("from_kind")), n.select(F.col("entity_id").alias("to_id"), F.col("kind").alias("to_kind"))
    # what is known of an edge's start is counted by its end before that is looked up
    per = meet(e, a, "from_id", e.count(), "left").groupBy("from_kind", "kind", "to_id").agg(F.count("*").alias("n"), F.count("page_id").alias("p"))
    return per.join(b, "to_id", "left").groupBy("from_kind", "kind", "to_kind").agg(F.sum("n").alias("n"), F.sum("p").alias("with_page")).filter("n > 1")


@query(f"{_E} SELECT from_id, to_id, kind FROM edges WHERE valid_from <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-30') AND to_id BETWEEN {PART} AND {NATION}")
def scan_as_of(spark, sf_dir):
    return as_of(edges(spark, sf_dir), "1996-06-30").filter(F.col("to_id").between(PART, NATION)).select("from_id", "to_id", "kind")


@query(f"""{_E}, {_ENDS}, {_DEG}, c AS (SELECT entity_id, count(DISTINCT kind) AS kinds, count(*) AS d FROM ends GROUP BY 1 HAVING count(*) >= 3)
SELECT 'entities' AS item, '' AS name, count(*) AS n FROM entities UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'kind', kind, count(*) FROM entities GROUP BY kind
UNION ALL SELECT 'central', entity_id::VARCHAR, degree FROM (SELECT * FROM deg ORDER BY degree DESC, entity_id LIMIT 10)
UNION ALL SELECT 'connector', entity_id::VARCHAR, kinds FROM (SELECT * FROM c ORDER BY kinds DESC, d DESC, entity_id LIMIT 10)""")
def graph_overview(spark, sf_dir):
    n, e = entities(spark, sf_dir), current(edges(spark, sf_dir))
    per = graph.endpoints(e.select("from_id", "to_id", "kind")).groupBy("entity_id").agg(F.count("*").alias("degree"), F.count_distinct("kind").alias("kinds"))
    item = lambda df, what, name, value: df.select(F.lit(what).alias("item"), name.alias("name"), value.alias("n"))
    key, none, c = F.col("entity_id").cast("string"), F.lit(""), F.col("c")
    whole = lambda df: df.agg(F.count("*").alias("c"))
    return (
        item(whole(n), "entities", none, c)
        .unionByName(item(whole(e), "edges", none, c))
        .unionByName(item(n.groupBy("kind").agg(F.count("*").alias("c")), "kind", F.col("kind"), c))
        .unionByName(item(per.orderBy(F.desc("degree"), "entity_id").limit(10), "central", key, F.col("degree")))
        .unionByName(item(per.filter("degree >= 3").orderBy(F.desc("kinds"), F.desc("degree"), "entity_id").limit(10), "connector", key, F.col("kinds")))
    )


_NEW = """old AS (SELECT 'c' || c_custkey AS from_slug, 'n' || c_nationkey AS to_slug, 'lives_in' AS kind, c_custkey, c_nationkey FROM customer),
new AS (SELECT from_slug, 'n' || (c_nationkey + k) % 25 AS to_slug, 'lives_in' AS kind, k AS seq, c_custkey FROM old, (SELECT unnest([1, 2]) AS k) WHERE c_custkey % 5 = 0
  UNION ALL SELECT from_slug, 'n' || k, 'uses', k, c_custkey FROM old, (SELECT unnest([3, 4]) AS k) WHERE c_custkey % 7 = 0 UNION ALL SELECT from_slug, 'nowhere', 'uses', 9, c_custkey FROM old WHERE c_custkey % 7 = 0)"""


@query(f"""WITH {_NEW}, last AS (SELECT * FROM new WHERE kind = 'uses' AND to_slug <> 'nowhere' UNION ALL SELECT * FROM new WHERE kind = 'lives_in' AND seq = 2)
SELECT from_slug, to_slug, kind, 'extracted' AS confidence, 1.0::DOUBLE AS score, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-06-01' END AS valid_to FROM old
UNION ALL SELECT from_slug, to_slug, kind, CASE WHEN kind = 'uses' THEN 'inferred' ELSE 'extracted' END, CASE WHEN kind = 'uses' THEN 0.7 ELSE 1.0 END, NULL FROM last""")
def persist_edges(spark, sf_dir):
    return _persisted(spark, sf_dir)[1].select("from_slug", "to_slug", "kind", "confidence", "score", "valid_to")


@query("""SELECT 'c' || c_custkey AS slug, 'person' AS kind, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'old,said' ELSE 'old' END AS aliases FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'place', n_name, 'said' FROM nation""")
def persist_entities(spark, sf_dir):
    return _persisted(spark, sf_dir)[0].select("slug", "kind", "name", F.array_join("aliases", ",").alias("aliases"))


def _persisted(spark, sf_dir):
    none = lambda kind: F.lit(None).cast(kind)
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    person, place = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), lambda k: F.concat(F.lit("n"), k.cast("string"))
    stored = c.select(person.alias("slug"), F.lit("person").alias("kind"), F.col("c_name").alias("name"), F.array(F.lit("old")).alias("aliases"))
    said = c.filter("c_custkey % 5 = 0 or c_custkey % 7 = 0").select(person.alias("slug"), F.lit("concept").alias("kind"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("said"), F.lit("old"))).alias("aliases"))
    said = said.unionByName(n.select(place(F.col("n_nationkey")).alias("slug"), F.lit("place").alias("kind"), F.col("n_name").alias("name"), F.array(F.lit("said")).alias("aliases")))
    moment = F.lit("2020-01-01").cast("timestamp")
    old = c.select(person.alias("from_slug"), place(F.col("c_nationkey")).alias("to_slug"), F.lit("lives_in").alias("kind"), F.lit(1.0).alias("weight"), F.lit("extracted").alias("confidence"), F.lit(1.0).alias("score"), none("long").alias("page_id"), moment.alias("valid_from"), none("timestamp").alias("valid_to"))
    edge = lambda df, to, kind, state: df.select(person.alias("from_slug"), to.alias("to_slug"), F.lit(kind).alias("kind"), F.lit(1.0).alias("weight"), F.lit(state).alias("state"), none("double").alias("score"), F.lit(1).cast("long").alias("page_id"), F.col("k").alias("seq"), none("timestamp").alias("valid_at"), none("timestamp").alias("invalid_at"))
    one = edge(c.filter("c_custkey % 5 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), place((F.col("c_nationkey") + F.col("k")) % 25), "lives_in", "extracted")
    two = edge(c.filter("c_custkey % 7 = 0").withColumn("k", F.explode(F.array(F.lit(3), F.lit(4), F.lit(9)))), F.when(F.col("k") == 9, "nowhere").otherwise(place(F.col("k"))), "uses", "inferred")
    return graph.persist(stored, old, said, one.unionByName(two), F.lit("2024-06-01").cast("timestamp"))


#: What was ordered and not yet shipped; of one order in fifty it isn't known when it was.
_OPEN = "open_ AS (SELECT l_orderkey, l_partkey, l_quantity, o_orderdate AS valid_from, CASE WHEN l_orderkey % 50 <> 0 THEN l_shipdate END AS valid_to FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _open_lines(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp").alias("valid_from"))
    shipped = F.when(F.col("l_orderkey") % 50 != 0, F.col("l_shipdate").cast("timestamp"))
    return meet(line, order, "l_orderkey", line.count()).select("l_orderkey", "o_custkey", "l_partkey", "l_quantity", "valid_from", shipped.alias("valid_to"))


@query(f"""WITH {_OPEN}, m AS (SELECT DISTINCT o_orderdate + INTERVAL 12 HOUR AS moment FROM orders)
SELECT moment, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity, max(l_orderkey) AS last FROM m JOIN open_ ON valid_from <= moment AND (valid_to IS NULL OR valid_to > moment) GROUP BY moment""")
def as_of_join(spark, sf_dir):
    """What was open at noon of every day on which something was ordered."""
    noon = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 12 * 3600 * 1_000_000)
    moments = table(spark, sf_dir, "orders").select(noon.alias("moment")).distinct()
    # lines that were open from and to the same moments are one row before they meet any
    spans = _open_lines(spark, sf_dir).groupBy("valid_from", "valid_to").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_orderkey").alias("last"))
    met = intervals.join_moments(moments, cut_round(spans))
    return met.groupBy("moment").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"), F.max("last").alias("last"))


@query(f"""WITH {_OPEN}, q AS (SELECT o_custkey AS question_id, min(o_orderdate) + INTERVAL 30 DAY AS as_of FROM orders GROUP BY o_custkey),
e AS (SELECT c.o_custkey + {PERSON} AS from_id, l_partkey + {PART} AS to_id, l_orderkey AS page_id, valid_from, valid_to FROM open_ JOIN orders c ON c.o_orderkey = l_orderkey),
ends AS (SELECT from_id AS entity_id, * FROM e UNION ALL SELECT to_id, * FROM e), deg AS (SELECT entity_id, count(*) AS degree FROM ends WHERE valid_to IS NULL GROUP BY entity_id),
w AS (SELECT question_id, page_id, round(sum(1.0 / (1 + 0.001 * pow(greatest(coalesce(degree, 0) - 1, 0), 2))), 6) AS weight FROM q JOIN ends e ON e.entity_id = question_id + {PERSON} AND valid_from <= as_of AND (valid_to IS NULL OR valid_to > as_of)
  LEFT JOIN deg ON deg.entity_id = e.entity_id GROUP BY ALL)
SELECT question_id, page_id, round(weight, 6) AS weight, row_number() OVER (PARTITION BY question_id ORDER BY weight DESC, page_id) AS rank FROM w QUALIFY rank <= 5""")
def entity_pages_as_of(spark, sf_dir):
    """Every customer asks with a moment of their own, a month after their first order; their edges' starts and ends decide."""
    lines = _open_lines(spark, sf_dir)
    e = cut_round(lines.select((F.col("o_custkey") + PERSON).alias("from_id"), (F.col("l_partkey") + PART).alias("to_id"), F.col("l_orderkey").alias("page_id"), "valid_from", "valid_to"))
    month = F.timestamp_micros(F.unix_micros(F.min(F.col("o_orderdate").cast("timestamp"))) + 30 * 86_400 * 1_000_000)
    q = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("question_id")).agg(month.alias("as_of"))
    found = q.select("question_id", "as_of", (F.col("question_id") + PERSON).alias("entity_id"), F.lit(1.0).alias("sim"))
    weights = retrieval.entity_weights(found, current(e), e)
    return top_k(weights, ["question_id"], [F.col("weight").desc(), F.col("page_id")], 5).select("question_id", "page_id", F.round("weight", 6).alias("weight"), "rank")


#: A graph in three steps: orders of even keys are known first; then the others come, every ninth of the first goes, and of customers
#: every fiftieth becomes the one before.
_MOVING = f"""e0 AS (SELECT o_custkey + {PERSON} AS from_id, l_partkey + {PART} AS to_id, l_orderkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
e1 AS (SELECT CASE WHEN (from_id - {PERSON}) % 50 = 0 AND from_id > {PERSON} THEN from_id - 1 ELSE from_id END AS from_id, to_id FROM e0 WHERE k % 2 = 1 OR k % 9 <> 0),
de AS (SELECT entity_id, count(*) AS degree FROM (SELECT from_id AS entity_id FROM e1 UNION ALL SELECT to_id FROM e1) GROUP BY entity_id)"""


def _kept_degrees(spark, sf_dir):
    lines = _open_lines(spark, sf_dir)
    e = lines.select((F.col("o_custkey") + PERSON).alias("from_id"), (F.col("l_partkey") + PART).alias("to_id"), F.col("l_orderkey").alias("k"))
    kept = degrees.Degrees.start(e.filter("k % 2 = 0"), f"{shared_dir(spark)}/degrees-{uuid.uuid4().hex}")
    kept.apply(e.filter("k % 2 = 1"))
    kept.apply(closed=e.filter("k % 2 = 0 AND k % 9 = 0"))
    now = e.filter("k % 2 = 1 OR k % 9 <> 0")
    names = table(spark, sf_dir, "customer").select((F.col("c_custkey") + PERSON).alias("entity_id"), (F.col("c_custkey") + PERSON - F.when((F.col("c_custkey") % 50 == 0) & (F.col("c_custkey") > 0), 1).otherwise(0)).alias("canonical_id"))
    kept.merge(names, now)
    return kept


@query(f"WITH {_MOVING} SELECT * FROM de")
def degree_kept(spark, sf_dir):
    """Degrees that were changed by what came, went and merged: those that a recount has."""
    return _kept_degrees(spark, sf_dir).read()


@query("""SELECT 'c' || c_custkey AS slug, CASE c_custkey % 3 WHEN 0 THEN '{"city":{"n":' || c_nationkey || '},"name":"' || c_name || '","old":1,"said":[1,2]}' WHEN 1 THEN '{"city":{"n":-1},"old":1}' ELSE '{"name":"' || c_name || '"}' END AS attributes FROM customer""")
def persist_attributes(spark, sf_dir):
    """Attributes of entities, key by key: what is said now before what is stored, nested values whole."""
    c = table(spark, sf_dir, "customer")
    slug, k = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.col("c_custkey") % 3
    side = lambda df, attributes: df.select(slug.alias("slug"), F.lit("person").alias("kind"), F.col("c_name").alias("name"), F.array().cast("array<string>").alias("aliases"), attributes.alias("attributes"))
    stored = side(c, F.when(k < 2, F.lit('{"city": {"n": -1}, "old": 1}')))
    name = F.concat(F.lit('"name": "'), "c_name", F.lit('"'))
    said = side(c.filter("c_custkey % 3 <> 1"), F.when(k == 0, F.concat(F.lit('{"said": [1, 2], "city": {"n": '), F.col("c_nationkey").cast("string"), F.lit("}, "), name, F.lit("}"))).otherwise(F.concat(F.lit("{"), name, F.lit("}"))))
    none = spark.createDataFrame([], "from_slug string, to_slug string, kind string, weight double, confidence string, score double, page_id long, valid_from timestamp, valid_to timestamp")
    new = spark.createDataFrame([], "from_slug string, to_slug string, kind string, weight double, state string, score double, page_id long, seq long, valid_at timestamp, invalid_at timestamp")
    return graph.persist(stored, none, said, new, F.lit("2024-06-01").cast("timestamp"))[0].select("slug", "attributes")
