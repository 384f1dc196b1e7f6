"""Usage, audit, mailbox, context packs, evaluation reports, questions, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, questions, text
from ..operators import context, ranking, resolve, router, usage
from ..operators.ranking import top_k
from ..sources.tables import PAGES_SQL, current, pages, table
from ..sources.tables import usage as usage_rows
from .base import query

_U = "u AS (SELECT event_id, user_id % 10 AS organization_id, user_id AS agent_id, event_type AS metric, ts, value, props FROM events)"
_MICRO = "epoch_us(ts)"


@query(f"WITH {_U} SELECT agent_id, metric, count(*) AS n, round(sum(value), 4) AS total FROM u GROUP BY ALL")
def usage_by_agent(spark, sf_dir):
    return usage_rows(spark, sf_dir).groupBy("agent_id", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {_U}, {PAGES_SQL}, o AS (SELECT unnest(range(0, 12)) AS organization_id), l AS (SELECT organization_id, organization_id * 100 AS max_queries FROM o WHERE organization_id % 3 <> 2),
p AS (SELECT organization_id, count(*) AS pages FROM pages_ WHERE valid_to IS NULL GROUP BY 1), n AS (SELECT organization_id, count(*) AS used FROM u GROUP BY 1)
SELECT o.organization_id, coalesce(max_queries, 0) AS max_queries, coalesce(pages, 0) AS pages, coalesce(used, 0) AS used, CASE WHEN coalesce(max_queries, 0) > 0 THEN coalesce(used, 0) * 100 // max_queries END AS percent
FROM o LEFT JOIN l USING (organization_id) LEFT JOIN p USING (organization_id) LEFT JOIN n USING (organization_id)""")
def usage_overview(spark, sf_dir):
    o = spark.range(12).toDF("organization_id")
    limits = o.filter("organization_id % 3 <> 2").withColumn("max_queries", F.col("organization_id") * 100)
    p = current(pages(spark, sf_dir)).groupBy("organization_id").agg(F.count("*").alias("pages"))
    n = usage_rows(spark, sf_dir).groupBy("organization_id").agg(F.count("*").alias("used"))
    out = o.join(limits, "organization_id", "left").join(p, "organization_id", "left").join(n, "organization_id", "left").fillna(0)
    return out.withColumn("percent", F.expr("CASE WHEN max_queries > 0 THEN used * 100 div max_queries END"))


@query(f"""WITH {_U}, n AS (SELECT event_id, organization_id, row_number() OVER (PARTITION BY organization_id, date_trunc('month', ts) ORDER BY ts, event_id) AS k, organization_id * 50 AS cap FROM u)
SELECT event_id, cap = 0 OR k <= cap AS allowed, CASE WHEN cap = 0 THEN k ELSE least(k, cap) END AS used FROM n""")
def quota_monthly(spark, sf_dir):
    u = usage_rows(spark, sf_dir)
    return usage.monthly_quota(u, F.col("organization_id") * 50, ["organization_id"], ["ts", "event_id"]).select("event_id", "allowed", "used")


GRACE_SQL = f"""WITH {_U}, g AS (SELECT event_id, agent_id, ts, value > 20 AS over, sum(CASE WHEN (value > 20) IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(value > 20) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS p FROM u)),
s AS (SELECT *, CASE WHEN over THEN min(ts) OVER (PARTITION BY agent_id, run) END AS since FROM g)
SELECT event_id, since AS over_since, coalesce({_MICRO} - epoch_us(since) > 72 * 3600 * 1000000::BIGINT, false) AS blocked FROM s"""


@query(GRACE_SQL)
def quota_grace(spark, sf_dir):
    return usage.grace(usage_rows(spark, sf_dir).withColumn("over", F.col("value") > 20), "agent_id").select("event_id", "over_since", "blocked")


#: The level after each request, walked in order by a recursive statement: 1 token a minute, at most 1.
BUCKET_SQL = f"""WITH RECURSIVE {_U}, r AS (SELECT organization_id, event_id, {_MICRO} AS us, row_number() OVER (PARTITION BY organization_id ORDER BY ts, event_id) AS k FROM u),
w AS (SELECT organization_id, event_id, us, k, 1.0::DOUBLE AS level, true AS admitted FROM r WHERE k = 1
  UNION ALL SELECT r.organization_id, r.event_id, r.us, r.k, l, l >= 1 FROM (SELECT r.*, least(1.0::DOUBLE, w.level - CASE WHEN w.admitted THEN 1 ELSE 0 END + (r.us - w.us) / 60e6) AS l FROM w JOIN r ON r.organization_id = w.organization_id AND r.k = w.k + 1) r)
SELECT event_id, admitted FROM w"""


@query(BUCKET_SQL)
def token_bucket(spark, sf_dir):
    return usage.token_bucket(usage_rows(spark, sf_dir), "organization_id", 1)


@query(f"WITH {_U} SELECT event_id, metric, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM u WHERE metric LIKE 'p%' ORDER BY ts DESC, event_id DESC LIMIT 200")
def events_prefix(spark, sf_dir):
    u = usage_rows(spark, sf_dir).filter(F.col("metric").startswith("p")).orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return u.select("event_id", "metric", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"""WITH {_U} SELECT event_id, CASE metric WHEN 'purchase' THEN 'memory.guideline' WHEN 'signup' THEN 'memory.skill' ELSE 'memory.write' END AS kind, '{{"k":' || json_extract_string(props, '$.k') || '}}' AS payload FROM u""")
def audit_events(spark, sf_dir):
    kind = F.when(F.col("metric") == "purchase", "memory.guideline").when(F.col("metric") == "signup", "memory.skill").otherwise("memory.write")
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")))
    return usage_rows(spark, sf_dir).select("event_id", kind.alias("kind"), payload.alias("payload"))


@query(f"WITH {_U}, r AS (SELECT * FROM u ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT event_id FROM r WHERE organization_id = 3 ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
def recent_requests(spark, sf_dir):
    latest = usage_rows(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    return latest.filter("organization_id = 3").orderBy(F.desc("ts"), F.desc("event_id")).offset(5).limit(20).select("event_id")


@query(f"WITH {_U} SELECT event_id FROM u WHERE ts + to_hours(least(72, greatest(1, (event_id % 100)))::INT) > TIMESTAMP '2024-01-20'")
def ttl_valid(spark, sf_dir):
    hours = F.least(F.lit(72), F.greatest(F.lit(1), F.col("event_id") % 100)).cast("int")
    return usage_rows(spark, sf_dir).filter(F.col("ts") + F.make_dt_interval(hours=hours) > F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query(f"""WITH {_U} SELECT agent_id, event_id, metric FROM u WHERE metric IN ('view', 'click') AND ts + INTERVAL 72 HOUR > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-20'
QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) = 1""")
def handoff_latest(spark, sf_dir):
    now = F.lit("2024-01-20").cast("timestamp")
    live = usage_rows(spark, sf_dir).filter(F.col("metric").isin("view", "click") & (F.col("ts") + F.expr("INTERVAL 72 HOURS") > now) & (F.col("ts") <= now))
    return top_k(live, ["agent_id"], [F.desc("ts"), F.desc("event_id")], 1).select("agent_id", "event_id", "metric")


@query(f"WITH {_U} SELECT event_id, event_id // 3 AS message_id, row_number() OVER (PARTITION BY event_id // 3 ORDER BY agent_id, ts, event_id) = 1 AS won FROM u WHERE metric <> 'error'")
def mailbox_claim(spark, sf_dir):
    claims = usage_rows(spark, sf_dir).filter("metric <> 'error'").withColumn("message_id", F.expr("event_id div 3"))
    return usage.first_claim(claims, "message_id", ["agent_id", "ts", "event_id"]).select("event_id", "message_id", "won")


@query(f"WITH {_U} SELECT agent_id, arg_max(metric, event_id) AS metric, max(event_id) AS event_id FROM u GROUP BY agent_id")
def upsert_latest(spark, sf_dir):
    u = usage_rows(spark, sf_dir).select("agent_id", "metric", "event_id")
    return resolve.upsert_latest(u.filter("event_id % 2 = 0"), u.filter("event_id % 2 = 1"), ["agent_id"], "event_id")


@query(f"""WITH {_U}, {PAGES_SQL} SELECT 'pages' AS item, count(*) AS n FROM pages_ WHERE valid_to IS NULL UNION ALL SELECT 'agents', count(DISTINCT agent_id) FROM u UNION ALL SELECT 'events', count(*) FROM u
UNION ALL SELECT 'chunks', count(*) FROM embeddings""")
def org_scalar_counts(spark, sf_dir):
    u = usage_rows(spark, sf_dir)
    one = lambda name, df, c=F.count("*"): df.agg(c.alias("n")).select(F.lit(name).alias("item"), "n")
    return one("pages", current(pages(spark, sf_dir))).unionByName(one("agents", u, F.count_distinct("agent_id"))).unionByName(one("events", u)).unionByName(one("chunks", table(spark, sf_dir, "embeddings")))


@query(f"WITH {_U} SELECT agent_id, count(*) * 100 // 200 AS percent FROM u GROUP BY agent_id")
def usage_percent(spark, sf_dir):
    return usage_rows(spark, sf_dir).groupBy("agent_id").agg(F.expr("count(*) * 100 div 200").alias("percent"))


@query(f"WITH {_U}, f AS (SELECT agent_id, event_id, metric, coalesce(json_extract_string(props, '$.k'), 'none') AS fact FROM u WHERE metric IN ('signup', 'purchase')) SELECT agent_id, event_id, metric, fact FROM f QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY event_id DESC) <= 30")
def known_facts(spark, sf_dir):
    f = usage_rows(spark, sf_dir).filter(F.col("metric").isin("signup", "purchase"))
    f = f.select("agent_id", "event_id", "metric", F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("fact"))
    return top_k(f, ["agent_id"], [F.desc("event_id")], 30).drop("rank")


@query(f"""WITH {_U}, f AS (SELECT organization_id, event_id, metric, json_extract_string(props, '$.k') AS fact, row_number() OVER (PARTITION BY organization_id ORDER BY event_id DESC) AS r FROM u WHERE metric IN ('signup', 'purchase'))
SELECT organization_id, string_agg('- ' || metric || ': ' || fact, chr(10) ORDER BY event_id DESC) AS profile FROM f WHERE r <= 200 GROUP BY organization_id""")
def profile_facts(spark, sf_dir):
    f = usage_rows(spark, sf_dir).filter(F.col("metric").isin("signup", "purchase")).withColumn("fact", F.get_json_object("props", "$.k"))
    f = top_k(f, ["organization_id"], [F.desc("event_id")], 200).withColumn("line", F.concat(F.lit("- "), "metric", F.lit(": "), "fact"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("event_id")).alias("o"), "line"))), lambda x: x["line"])
    return f.groupBy("organization_id").agg(F.array_join(lines, "\n").alias("profile"))


@query(f"WITH {_U} SELECT agent_id, count(*) FILTER (metric = 'signup') AS preferences, count(*) FILTER (metric = 'purchase') AS lessons FROM u GROUP BY agent_id")
def facts_by_kind(spark, sf_dir):
    return usage_rows(spark, sf_dir).groupBy("agent_id").agg(F.count_if(F.col("metric") == "signup").alias("preferences"), F.count_if(F.col("metric") == "purchase").alias("lessons"))


def _section_sql(name: str, rows: str, line: str, budget: int) -> str:
    tail = "" if name in ("guidelines", "handoff", "profile") else " || chr(10)"
    title = context.TITLES[name].replace("\n", "' || chr(10) || '")
    return f"""SELECT organization_id, '{name}' AS section, {list(context.SECTIONS).index(name)} AS position, CASE WHEN length(body) > {budget} THEN regexp_replace(substr(body, 1, {budget}), '[ \\t\\n]+$', '') || chr(10) || '…[cut]' || chr(10) || chr(10) ELSE body END AS body, length(body) > {budget} AS cut
    FROM (SELECT organization_id, '{title}' || string_agg({line}, '' ORDER BY seq DESC){tail} AS body FROM (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY organization_id ORDER BY seq DESC) <= {context.ROWS[name]}) GROUP BY organization_id)"""


_MAIL = "FROM u WHERE ts + INTERVAL 72 HOUR > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-20' AND metric = "
_COLLAPSED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PACK = 4000
_SECTION_SQL = {
    "inbox": (f"SELECT organization_id, metric AS title, coalesce(json_extract_string(props, '$.k'), '') AS content, event_id AS seq {_MAIL}'error'", "'- ' || title || ': ' || " + _COLLAPSED.format("content") + " || chr(10)"),
    "handoff": (f"SELECT organization_id, 'handoff' AS title, 'user ' || agent_id || ' left ' || coalesce(json_extract_string(props, '$.k'), '') AS content, event_id AS seq {_MAIL}'view'", "trim(content) || chr(10) || chr(10)"),
    "guidelines": ("SELECT organization_id, title, substr(content, 1, 600) AS content, page_id AS seq FROM pages_ WHERE valid_to IS NULL AND domain = 'src3'", "'### ' || trim(title) || chr(10) || trim(content) || chr(10) || chr(10)"),
    "profile": ("SELECT organization_id, 'profile' AS title, count(*) || ' events of ' || count(DISTINCT metric) || ' kinds' AS content, 1 AS seq FROM u GROUP BY 1", "trim(content) || chr(10) || chr(10)"),
    "index": ("SELECT organization_id, title, content, page_id AS seq FROM pages_ WHERE valid_to IS NULL AND domain = 'src4'", "'- [[' || trim(title) || ']]' || CASE WHEN trim(content) <> '' THEN ' — ' || " + _COLLAPSED.format("substr(trim(content), 1, 220)") + " ELSE '' END || chr(10)"),
    "recent": ("SELECT organization_id, title, strftime(created_at, '%Y-%m-%d') AS day, domain, page_id AS seq FROM pages_ WHERE valid_to IS NULL AND domain <> 'src3'", "'- ' || day || ' · ' || trim(title) || ' (' || domain || ')' || chr(10)"),
}


@query(f"WITH {_U}, {PAGES_SQL} " + " UNION ALL ".join(_section_sql(k, *v, _PACK * context.SECTIONS[k] // 100) for k, v in _SECTION_SQL.items()))
def context_pack(spark, sf_dir):
    u, p = usage_rows(spark, sf_dir), current(pages(spark, sf_dir))
    now, none = F.lit("2024-01-20").cast("timestamp"), F.lit(None).cast("string")
    live = u.filter((F.col("ts") + F.expr("INTERVAL 72 HOURS") > now) & (F.col("ts") <= now)).withColumn("k", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    row = lambda df, title, content, seq, day=none, domain=none: df.select("organization_id", title.alias("title"), content.alias("content"), day.alias("day"), domain.alias("domain"), seq.alias("seq"))
    page = lambda where, n=None: row(p.filter(where), F.col("title"), F.substring("content", 1, n) if n else F.col("content"), F.col("page_id"), F.date_format("created_at", "yyyy-MM-dd"), F.col("domain"))
    per = u.groupBy("organization_id").agg(F.count("*").alias("n"), F.count_distinct("metric").alias("m"))
    sections = {
        "inbox": row(live.filter("metric = 'error'"), F.col("metric"), F.col("k"), F.col("event_id")),
        "handoff": row(live.filter("metric = 'view'"), F.lit("handoff"), F.concat(F.lit("user "), F.col("agent_id").cast("string"), F.lit(" left "), "k"), F.col("event_id")),
        "guidelines": page("domain = 'src3'", 600),
        "profile": row(per, F.lit("profile"), F.concat(F.col("n").cast("string"), F.lit(" events of "), F.col("m").cast("string"), F.lit(" kinds")), F.lit(1)),
        "index": page("domain = 'src4'"),
        "recent": page("domain <> 'src3'"),
    }
    return context.pack(sections, _PACK)


@query("""WITH e AS (SELECT doc_id, lang AS type, quality = 1 AS correct, (doc_id * 7919) % 1000 AS latency FROM labels JOIN documents USING (doc_id))
SELECT type, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, list_sort(list(latency))[len(list(latency)) // 2 + 1] AS p50 FROM e GROUP BY type""")
def eval_report(spark, sf_dir):
    return _eval(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), usage.upper_median("latency").alias("p50"))


def _eval(spark, sf_dir):
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type"))  # noqa: E741
    return l.join(d, "doc_id").select("doc_id", "type", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("other"), (F.col("doc_id") * 7919 % 1000).alias("latency"))


@query("""WITH r AS (SELECT doc_id % 5 AS run, avg(quality) AS score FROM labels GROUP BY 1) SELECT count(*) AS runs, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, round(min(score), 6) AS low, round(max(score), 6) AS high, round(max(score) - min(score), 6) AS band FROM r""")
def bench_replicate(spark, sf_dir):
    r = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).alias("run")).agg(F.avg("quality").alias("score"))
    s = F.col("score")
    return r.agg(F.count("*").alias("runs"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_pop(s), 6).alias("sd"), F.round(F.min(s), 6).alias("low"), F.round(F.max(s), 6).alias("high"), F.round(F.max(s) - F.min(s), 6).alias("band"))


@query("""WITH v AS (SELECT event_id // 3 AS item, CASE WHEN event_type <> 'error' THEN event_type IN ('click', 'view') END AS vote FROM events)
SELECT item, count(vote) AS answered, coalesce(count(*) FILTER (vote) * 2 > count(vote), false) AS yes FROM v GROUP BY item""")
def judge_majority(spark, sf_dir):
    v = table(spark, sf_dir, "events").select(F.expr("event_id div 3").alias("item"), F.when(F.col("event_type") != "error", F.col("event_type").isin("click", "view")).alias("vote"))
    return v.groupBy("item").agg(F.count("vote").alias("answered"), (F.count_if("vote") * 2 > F.count("vote")).alias("yes"))


@query("""WITH e AS (SELECT lang AS type, quality = 1 AS correct, toxic = 1 AS other, (doc_id * 7919) % 1000 AS latency FROM labels JOIN documents USING (doc_id))
SELECT type, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, list_sort(list(latency))[count(*) // 2 + 1] AS p50, list_sort(list(latency))[floor(0.95 * count(*))::INT + 1] AS p95, count(*) FILTER (correct <> other) AS flips FROM e GROUP BY type""")
def bench_summary(spark, sf_dir):
    return _eval(spark, sf_dir).groupBy("type").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), usage.upper_median("latency").alias("p50"), usage.from_top("latency", "0.05").alias("p95"), F.count_if(F.col("correct") != F.col("other")).alias("flips")
    )


@query("""WITH k AS (SELECT count(DISTINCT lang) AS k FROM documents), r AS (SELECT doc_id, lang, sha256(doc_id || '-42') AS o, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || '-42')) AS r FROM documents)
SELECT doc_id, lang FROM r, k WHERE r <= greatest(1, 50 // k) ORDER BY r, o LIMIT 50""")
def stratified_sample(spark, sf_dir):
    return usage.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 50, 42)


#: How the turns of conversations are made questions: what stands before their text.
_ASKS = ["How many of these did I read: ", "what is my current ", "Which city did I visit first, ", "Any good restaurants you can suggest? ", "Quantas vezes fui? ", "Tell me about ", "days between June 1 and June 5: ", "the total cost of it ",
    "What should I cook? ", "vou contigo, ", "o que vale a pena ler? ", "what happened last friday? ", "three weeks ago "]
_NOW = "2026-03-31"


def _regex(column: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


_KIND = f"""asked AS (SELECT conv_id * 100 + turn AS id, ([{', '.join("'" + x + "'" for x in _ASKS)}])[(conv_id + turn) % {len(_ASKS)} + 1] || text AS q, (conv_id * 7 + turn * 13) % 60 AS requested FROM conversations),
kind AS (SELECT id, requested, {_regex('q', questions.COUNT)} AS is_count, {_regex('q', questions.COUNT, questions.REASONING)} AS reasoning, {_regex('q', questions.PREFERENCE)} AS preference,
  {_regex('q', questions.TEMPORAL, dates.BETWEEN, dates.SINCE, dates.AGO_WORD, dates.UNTIL, dates.EN_DATE, dates.WORD_AGO, dates.DAY_EN, dates.LAST_UNIT)} AS temporal FROM asked),
wide AS (SELECT *, CASE WHEN reasoning OR preference THEN greatest(requested, {questions.RECALL_LIMIT}) ELSE requested END AS effective FROM kind)"""


def _asked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    start = F.element_at(F.array(*[F.lit(x) for x in _ASKS]), ((F.col("conv_id") + F.col("turn")) % len(_ASKS) + 1).cast("int"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat(start, "text").alias("q"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 60).alias("requested"))


@query(f"WITH {_KIND} SELECT id, is_count, reasoning, preference, temporal FROM kind")
def question_classify(spark, sf_dir):
    q, now = F.col("q"), F.lit(_NOW).cast("date")
    return _asked(spark, sf_dir).select("id", questions.is_count(q).alias("is_count"), questions.needs_reasoning(q).alias("reasoning"), questions.is_preference(q).alias("preference"), questions.is_temporal(q, now).alias("temporal"))


@query(f"WITH {_KIND} SELECT id, requested, effective FROM wide")
def effective_limit(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", "requested", questions.effective_limit(F.col("q"), F.col("requested")).alias("effective"))


@query(f"WITH {_KIND} SELECT id, requested, effective, greatest(20, 5 * effective) AS search_limit, greatest(50, 5 * greatest(20, 5 * effective)) AS pool FROM wide")
def pool_limits(spark, sf_dir):
    """How many results a question's search takes, and each of its channels."""
    from ..operators.search import pooled

    r = _asked(spark, sf_dir).select("id", "requested", questions.effective_limit(F.col("q"), F.col("requested")).alias("effective"))
    r = r.withColumns({"search_limit": F.greatest(F.lit(20), 5 * F.col("effective")), "mode": F.lit("hybrid")})
    return pooled(r.withColumn("limit", F.col("search_limit"))).select("id", "requested", "effective", "search_limit", "pool")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS expansion FROM events")
def json_settings(spark, sf_dir):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, '{"graph_expansion": "true"}').when(k == 1, '{"graph_expansion": false}').otherwise('{"graph_expansion": "x"}')
    found = F.coalesce(F.get_json_object(raw, "$.graph_expansion").try_cast("boolean"), F.lit(True))
    return table(spark, sf_dir, "events").select("event_id", found.alias("expansion"))


@query("SELECT event_id, unnest([event_id, event_id + 1]) AS source_id FROM events")
def json_explode_ids(spark, sf_dir):
    raw = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(", "), (F.col("event_id") + 1).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json(raw, "array<bigint>")).alias("source_id"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END AS entities, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS first FROM events""")
def llm_json_parse(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 3, "sorry, no json").otherwise(F.concat(F.lit('Sure:\n```json\n{"entities": [{"name": "'), "event_type", F.lit('", "kind": "X"}, {"name": "b"}, {"kind": "c"}], "edges": []}\n```')))
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(body != "", body), "entities array<struct<name:string,kind:string>>, edges array<struct<from_name:string,to_name:string,kind:string>>")
    found = F.filter(F.coalesce(parsed["entities"], F.array().cast("array<struct<name:string,kind:string>>")), lambda x: F.trim(x["name"]) != "")
    return table(spark, sf_dir, "events").select("event_id", F.size(found).alias("entities"), F.get(found, F.lit(0))["name"].alias("first"))


@query(f"""WITH {_U}, t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'all' WHEN 1 THEN '' ELSE (event_id % 300 - 20)::VARCHAR END AS l, CASE event_id % 3 WHEN 0 THEN '-4' WHEN 1 THEN '1.5' ELSE (event_id % 40)::VARCHAR END AS o FROM u)
SELECT event_id, least(CASE WHEN try_cast(l AS BIGINT) > 0 THEN try_cast(l AS BIGINT) ELSE 50 END, 200) AS limit_, CASE WHEN event_id % 3 = 2 THEN event_id % 40 ELSE 0 END AS offset_ FROM t""")
def page_params(spark, sf_dir):
    """What requests ask for by limit and offset, as texts."""
    k = F.col("event_id")
    limit = F.when(k % 5 == 0, "all").when(k % 5 == 1, "").otherwise((k % 300 - 20).cast("string"))
    offset = F.when(k % 3 == 0, "-4").when(k % 3 == 1, "1.5").otherwise((k % 40).cast("string"))
    n, skip = ranking.page_params(limit, offset, 50, 200)
    return table(spark, sf_dir, "events").select("event_id", n.alias("limit_"), skip.alias("offset_"))


def _failing(name: str, fails: dict[int, object], every: int):
    """A provider that answers with the start of what it is asked, or fails by the length of that: with a status, or the network."""

    def make():
        def model(text: str) -> str:
            kind = fails.get(len(text) % every)
            if kind == "network":
                raise ConnectionError("no route")
            if kind:
                raise router.Failure(kind)
            return f"{name}: {text[:20]}"

        return model

    return router.Provider(name, make)


@query("""WITH c AS (SELECT conv_id * 100 + turn AS id, text, length(text) AS n FROM conversations),
r AS (SELECT *, CASE WHEN n % 7 IN (0, 1, 3) THEN CASE WHEN n % 5 IN (0, 2) THEN CASE WHEN n % 3 = 0 THEN 'none' ELSE 'third' END WHEN n % 5 = 1 THEN 'final' ELSE 'second' END WHEN n % 7 = 2 THEN 'final' ELSE 'first' END AS who FROM c)
SELECT id, CASE WHEN who NOT IN ('none', 'final') THEN who || ': ' || substr(text, 1, 20) END AS answer, CASE who WHEN 'first' THEN 0 WHEN 'second' THEN 1 WHEN 'third' THEN 2 END AS tier,
  CASE WHEN who = 'first' OR n % 7 = 2 THEN 1 WHEN who IN ('second', 'final') THEN 2 ELSE 3 END AS calls, CASE WHEN who = 'none' THEN 'third: no route' WHEN who = 'final' THEN CASE WHEN n % 7 = 2 THEN 'first: status 400' ELSE 'second: status 401' END END AS error FROM r""")
def provider_fallback(spark, sf_dir):
    """Every turn is asked of three providers in order, each of which fails for some: for now or for good."""
    providers = [_failing("first", {0: 429, 1: 503, 2: 400, 3: "network"}, 7), _failing("second", {0: 500, 1: 401, 2: 408}, 5), _failing("third", {0: "network"}, 3)]
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("prompt"))
    return router.answered(c, providers).select("id", "answer", "tier", "calls", "error")
