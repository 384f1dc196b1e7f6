"""From questions to answers: analysis, retrieval, reranking, prompt, generation, clean-up.

Models are plug-ins: a function from Columns to a Column, such as an iterator pandas UDF that loads its model once a
worker. The stand-ins here are deterministic and need no model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, questions, text
from . import ranking, retrieval, search
from .joins import small
from .state import cut

Generator = Callable[[Column, Column, Column], Column]
PER_PAGE, RERANKED, SESSIONS = 3, 64, 8
#: Tokens of an answer, and of thought before it where a question asks for reasoning.
ANSWER_TOKENS, THOUGHT_TOKENS = 2048, 8192


def stand_in(question: Column, prompt: Column, route: Column) -> Column:
    """Repeats the first source in the form that a model is asked for."""
    return F.concat(F.lit("<scratch>thinking</scratch><final>"), F.regexp_extract(prompt, r"(?m)^\[1\] (.*)$", 1), F.lit(" https://elsewhere.invalid/x</final>"))


def by_conjunction(question: Column) -> Column:
    """A stand-in for a model that takes a question apart: its parts around "and" or "e", if there are two to five."""
    parts = F.filter(F.transform(F.split(question, r"(?i)\s+(?:and|e)\s+"), lambda x: F.regexp_replace(x, r"^[\s?]+|[\s?]+$", "")), lambda x: x != "")
    return F.when(F.size(parts).between(2, 5), parts).otherwise(F.array().cast("array<string>"))


def analyse(asked: DataFrame, now: Column) -> DataFrame:
    """What a question's words say: how many results it needs, which model it goes to, how much that may think and write."""
    q = F.col("text")
    preference = questions.is_preference(q)
    reasoning = questions.needs_reasoning(q) & ~preference
    return asked.select(
        "question_id", "text",
        questions.effective_limit(q, F.col("limit")).alias("effective"),
        questions.is_count(q).alias("is_count"), questions.is_temporal(q, now).alias("temporal"), preference.alias("preference"), reasoning.alias("reasoning"),
        F.when(questions.is_temporal(q, now), "temporal").otherwise("default").alias("route"),
        F.when(reasoning, THOUGHT_TOKENS).otherwise(0).alias("thought_tokens"), F.when(reasoning, THOUGHT_TOKENS + ANSWER_TOKENS).otherwise(ANSWER_TOKENS).alias("max_tokens"),
        F.array_join(dates.date_math(q, now), "\n").alias("facts"), dates.strip_context_date(q).alias("asked"),
    )


def retrieve(asked: DataFrame, corpus: search.Corpus, multi_hop: bool = False, decompose: Callable[[Column], Column] = by_conjunction, **how) -> DataFrame:
    """Candidates of questions as ``search`` takes them, several times what they need, as of the moment that they ask about:
    (question_id, item_id, page, rank, score, content, day). With ``multi_hop`` also those of the parts that ``decompose``
    finds: the question first, then part by part, every item where it comes first."""
    today, corpus = F.to_date("now"), search.placed(corpus)
    wide = asked.withColumn("limit", F.greatest(F.lit(20), 5 * questions.effective_limit(F.col("text"), F.col("limit")))).withColumn("as_of", F.coalesce("as_of", dates.detect_as_of(F.col("text"), F.col("now"))))
    if multi_hop:
        whole = F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("said")))
        parts = F.transform(decompose(F.col("text")), lambda x, i: F.struct((i + 1).alias("part"), x.alias("said")))
        wide = wide.withColumn("p", F.explode(F.concat(whole, parts))).withColumn("text", F.col("p.said")).withColumn("terms", F.when(F.col("p.part") == 0, F.col("terms")).otherwise(F.col("p.said")))
        wide = wide.withColumn("question_id", F.struct(F.col("question_id").alias("of"), F.col("p.part").alias("part"))).drop("p")
    found = search.search(wide, corpus, **how)
    if multi_hop:
        found = found.withColumn("part", F.col("question_id.part")).withColumn("question_id", F.col("question_id.of"))
        found = ranking.first_seen(found.withColumnRenamed("position", "of_part"), ["question_id"], "item_id", ["part", "of_part"])
    day = corpus.places.select("item_id", F.col("session_day").alias("day"))
    found = cut(found.select("question_id", "item_id", F.col("page_id").alias("page"), F.col("position").alias("rank"), "score", F.col("text").alias("content")))
    return day.join(small(found), "item_id").select(*found.columns, "day")


def prompts(asked: DataFrame, results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """asked: as ``analyse`` gives it; results: (question_id, position, content); known: facts (question_id, fact, seq) for
    questions about preferences."""
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), text.collapse(F.substring("content", 1, 300)))
    joined = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v.alias("line")))), lambda x: x["line"]), "\n")
    sources = results.groupBy("question_id").agg(joined("position", line).alias("sources"), F.count("*").alias("n_sources"))
    facts = F.when(F.col("facts") != "", F.concat(F.lit("COMPUTED FACTS:\n"), "facts", F.lit("\n"))).otherwise("")
    rows = asked.join(sources, "question_id", "left")
    said = F.lit("")
    if known is not None:
        own = known.groupBy("question_id").agg(joined("seq", F.concat(F.lit("- "), "fact")).alias("known"))
        rows = rows.join(own, "question_id", "left")
        said = F.when(F.col("preference") & F.col("known").isNotNull(), F.concat(F.lit("KNOWN PREFERENCES:\n"), "known", F.lit("\n"))).otherwise("")
    prompt = F.concat(F.lit("Question: "), "text", F.lit("\n"), said, facts, F.lit("Sources:\n"), F.coalesce("sources", F.lit("(none)")))
    return rows.select(*asked.columns, F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), prompt.alias("prompt"))


def select(analysed: DataFrame, candidates: DataFrame, rerank: Callable[[Column, Column], Column] = retrieval.overlap) -> DataFrame:
    """The sources of each answer, (question_id, position, item_id, content): reranked, or, where a question counts, the best
    pages' results in turn; few of each page; the latest day first, as later statements replace earlier ones."""
    a = analysed.select("question_id", "asked", "effective", "is_count")
    pool = candidates.join(small(a), "question_id")
    sharp = pool.filter(~F.col("is_count") & (F.col("rank") <= RERANKED)).withColumn("s", rerank(F.col("asked"), F.col("content")))
    sharp = ranking.ranked(sharp, ["question_id"], [F.col("s").desc(), F.col("rank")], "order").withColumn("rank", F.col("order")).drop("order", "s")
    wide = ranking.round_robin(pool.filter("is_count"), ["question_id"], "page", SESSIONS, 1000).withColumn("rank", F.col("position")).select(*sharp.columns)
    capped = ranking.hard_cap(sharp.unionByName(wide), ["question_id"], "page", PER_PAGE)
    kept = ranking.ranked(capped, ["question_id"], [F.col("rank")], "order").filter(F.col("order") <= F.col("effective"))
    return ranking.ranked(kept, ["question_id"], [F.col("day").desc_nulls_last(), F.col("order")], "position").select("question_id", "position", "item_id", "content")


def answer(asked: DataFrame, candidates: DataFrame, now: Column, generate: Generator = stand_in, rerank: Callable[[Column, Column], Column] = retrieval.overlap, known: DataFrame | None = None) -> DataFrame:
    """asked: (question_id, text, limit); candidates: (question_id, item_id, page, rank, score, content, day)."""
    a = cut(analyse(asked, now))
    p = prompts(a, select(a, candidates, rerank), known)
    raw = generate(F.col("text"), F.col("prompt"), F.col("route"))
    clean, masked = text.egress_filter(text.extract_final(text.strip_thinking(raw)), F.concat_ws(" ", "text", "sources"))
    return p.select("question_id", "route", "max_tokens", "n_sources", F.char_length("prompt").alias("prompt_chars"), clean.alias("answer"), masked.alias("masked"))


def events(answers: DataFrame, size: int = 40) -> DataFrame:
    """What a client is sent, in order: sources, pieces of the answer, done."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.char_length("answer") / size).cast("int") - 1)), lambda i: F.substr(F.col("answer"), i * size + 1, F.lit(size)))
    every = F.concat(
        F.array(F.struct(F.lit("sources").alias("event"), F.col("n_sources").cast("string").alias("data"))),
        F.transform(pieces, lambda x: F.struct(F.lit("delta").alias("event"), x.alias("data"))),
        F.array(F.struct(F.lit("done").alias("event"), F.lit("").alias("data"))),
    )
    return answers.select("question_id", F.posexplode(every).alias("seq", "e")).select("question_id", "seq", "e.event", "e.data")
