"""Retrieval channels over many questions at once.

Questions are taken in blocks of at most ``BLOCK``, which are counted, so whatever is joined by broadcast is a block of
them; found entities and frontiers are cut and broadcast only after they were counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.text import words
from . import graph
from .intervals import holds
from .joins import meet, small
from .ranking import ranked, top_k
from .state import cut

#: Questions that are compared with all items at a time.
BLOCK = 1000
VALID = ["valid_from", "valid_to"]


def by_block(questions: DataFrame, run: Callable[[DataFrame], DataFrame], size: int | None = None) -> DataFrame:
    """``run`` over blocks of ``questions``, of ``BLOCK`` or ``size``."""
    blocks = -(-questions.count() // (size or BLOCK))
    if blocks <= 1:
        return run(questions)
    out = None
    for b in range(blocks):
        # hashes fall unevenly, so a block is sized for half
        one = run(questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(2 * blocks)).isin(2 * b, 2 * b + 1)))
        out = one if out is None else out.unionByName(one)
    return out


def vector_channel(questions: DataFrame, vectors: DataFrame, k: int | Column, gate: float = 1.0, visible: Column | None = None) -> DataFrame:
    """Exact nearest vectors: questions (question_id, qvec), vectors (item_id, embedding); distances beyond ``gate`` go, and
    what ``visible``, a condition on both sides' columns, excludes. Vectors of another size than the question's are refused.

    A block of questions is broadcast and each vector is compared with all of it: an exact scan, whose partial top-k is
    taken before the shuffle."""

    def run(part: DataFrame) -> DataFrame:
        fits = F.when(F.size("qvec") == F.size("embedding"), True).otherwise(F.raise_error(F.lit("vectors of different sizes")))
        on = F.lit(True) if visible is None else visible
        near = vectors.filter(F.col("embedding").isNotNull()).join(F.broadcast(part.filter("qvec IS NOT NULL")), on).filter(fits)
        near = near.withColumn("distance", scores.cosine_distance(F.col("qvec"), F.col("embedding"))).filter(F.col("distance") <= gate)
        return top_k(near, ["question_id"], [F.round("distance", 9), F.col("item_id")], k).select("question_id", "item_id", "distance", "rank")

    return by_block(questions, run)


def keyword_hits(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts with all of a question's terms: (question_id, item_id, fts). questions (question_id, terms), texts (item_id, text).

    rank score: sum over terms of (1 + ln tf) / (1 + ln words)."""

    def run(part: DataFrame) -> DataFrame:
        asked = part.select("question_id", F.explode(F.array_distinct(words(F.col("terms")))).alias("term"))
        need = asked.groupBy("question_id").agg(F.count("*").alias("need"))
        # words are looked up in the block's terms by a hash; the rest of a text never leaves the scan
        terms = F.broadcast(asked.select("term").distinct())
        own = texts.select("item_id", words(F.col("text")).alias("w")).select("item_id", F.size("w").alias("size"), F.explode("w").alias("term")).join(terms, "term")
        counts = own.groupBy("item_id", "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))
        hit = counts.join(F.broadcast(asked), "term").groupBy("question_id", "item_id").agg(F.count("*").alias("have"), F.sum((1 + F.ln("tf")) / (1 + F.ln("size"))).alias("fts"))
        full = hit.join(F.broadcast(need), "question_id").filter(F.col("have") == F.col("need"))
        return full.select("question_id", "item_id", F.round("fts", 9).alias("fts"))

    return by_block(questions, run)


def keyword_channel(questions: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    return top_k(keyword_hits(questions, texts), ["question_id"], [F.col("fts").desc(), F.col("item_id")], k)


def date_hits(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts that share date tokens, by number shared: questions (question_id, tokens), texts (item_id, tokens)."""

    def run(part: DataFrame) -> DataFrame:
        q = part.select("question_id", F.explode("tokens").alias("token")).distinct()
        t = texts.select("item_id", F.explode("tokens").alias("token")).distinct()
        return t.join(F.broadcast(q), "token").groupBy("question_id", "item_id").agg(F.count("*").alias("shared"))

    return by_block(questions, run)


def date_channel(questions: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    return top_k(date_hits(questions, texts), ["question_id"], [F.col("shared").desc(), F.col("item_id")], k)


def alike(questions: DataFrame, entities: DataFrame, threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(question_id, entity_id, *keep, sim) of names with trigram similarity to a question (question_id, text; entity_id, name),
    found through shared trigrams. ``keep`` are columns that tell versions of an entity apart."""
    own = ["entity_id", *keep]

    def run(part: DataFrame) -> DataFrame:
        q = part.select("question_id", scores.trigrams(F.col("text")).alias("t")).select("question_id", F.size("t").alias("qn"), F.explode("t").alias("g"))
        e = entities.select(*own, scores.trigrams(F.col("name")).alias("t")).select(*own, F.size("t").alias("en"), F.explode("t").alias("g"))
        both = e.join(F.broadcast(q), "g").groupBy("question_id", *own).agg(F.count("*").alias("n"), F.first("qn").alias("qn"), F.first("en").alias("en"))
        return both.select("question_id", *own, F.round(F.col("n") / (F.col("qn") + F.col("en") - F.col("n")), 9).alias("sim")).filter(F.col("sim") >= threshold)

    return by_block(questions, run)


def named(questions: DataFrame, entities: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(question_id, entity_id, *keep, sim 1) of entities (entity_id, aliases) with an alias that stands in a question's text.

    An alias is contained only where its first three characters are, so aliases and questions meet by those."""
    own = ["entity_id", *keep]

    def run(part: DataFrame) -> DataFrame:
        low = part.select("question_id", F.lower("text").alias("q"))
        starts = F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("q")), lambda i: F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.substr(F.col("q"), i, k))))
        grams = low.filter("q <> ''").select("question_id", "q", F.explode(F.array_distinct(starts)).alias("start"))
        alias = entities.select(*own, F.explode(F.array_distinct("aliases")).alias("a")).select(*own, F.lower("a").alias("a")).filter("a <> ''")
        met = alias.withColumn("start", F.substring("a", 1, 3)).join(F.broadcast(grams), "start").filter(F.contains(F.col("q"), F.col("a")))
        return met.select("question_id", *own, F.lit(1.0).alias("sim")).distinct()

    return by_block(questions, run)


def seeds(questions: DataFrame, entities: DataFrame, k: int, threshold: float = 0.3) -> DataFrame:
    """The entities most like each question: by name and, if entities have them, by aliases, the better of both.

    Questions with a moment (as_of; null is the present) meet only what of the entities (valid_from, valid_to) held then, and
    keep it."""
    moment = "as_of" in questions.columns
    keep = ("valid_from", "valid_to") if moment else ()
    sim = alike(questions, entities, threshold, keep)
    if "aliases" in entities.columns:
        sim = sim.unionByName(named(questions, entities, keep))
    if moment:
        sim = sim.join(small(questions.select("question_id", "as_of")), "question_id").filter(holds(F.col("as_of"), F.col("valid_from"), F.col("valid_to")))
    if moment or "aliases" in entities.columns:
        sim = sim.groupBy("question_id", "entity_id", *(["as_of"] if moment else [])).agg(F.max("sim").alias("sim"))
    return top_k(sim, ["question_id"], [F.col("sim").desc(), F.col("entity_id")], k, "seed_rank")


def _at(ends: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Ends at what was found: what is few is broadcast, for more ends between the least and the greatest of them are dealt to
    tasks of bounded size."""
    near = small(found)
    if near is not found:
        return ends.join(near, key)
    low, high = found.agg(F.min(key), F.max(key)).first()
    ends = ends.filter(F.col(key).between(low, high))
    return meet(ends, found, key, ends.count())


def page_weights(found: DataFrame, edges: DataFrame, weight: Column) -> DataFrame:
    """Weights of pages whose edges touch found entities; an edge with both ends found counts twice. Entities found for a moment
    (as_of) count by edges that held then."""
    moment = "as_of" in found.columns
    ends = graph.endpoints(edges.filter("page_id IS NOT NULL").select("from_id", "to_id", "page_id", *(VALID if moment else [])))
    met = _at(ends, found, "entity_id")
    met = met.filter(holds(F.col("as_of"), F.col("valid_from"), F.col("valid_to"))) if moment else met
    return met.groupBy("question_id", "page_id").agg(F.sum(weight).alias("weight"))


def degrees_of(ids: DataFrame, edges: DataFrame, degrees: DataFrame | None) -> DataFrame:
    """(entity_id, degree) of some entities: looked up in a kept table, else counted over ``edges``."""
    if degrees is not None:
        return degrees.select("entity_id", "degree").join(small(ids.distinct()), "entity_id", "left_semi")
    ids = ids.distinct()
    near = small(ids)
    # at many, edges are counted before they are looked up
    return graph.degree(edges).join(ids, "entity_id", "left_semi") if near is ids else graph.degree(graph.touching(edges, near))


def entity_weights(found: DataFrame, edges: DataFrame, touched: DataFrame | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """(question_id, page_id, weight): the similarity of found entities (question_id, entity_id, sim, and as_of for a moment),
    damped by degree, summed over their edges.

    Degrees are those of a kept table (``degrees``), or counted over ``edges``; pages are over ``touched`` (edges with their
    validity, of which those count that held at as_of), or ``edges``."""
    moment = ["as_of"] if "as_of" in found.columns else []
    found = cut(found.select("question_id", "entity_id", *moment, "sim"))
    ids, of = found.select("entity_id").distinct(), edges if touched is None else touched
    ends = graph.endpoints(of.filter("page_id IS NOT NULL").select("from_id", "to_id", "page_id", *(VALID if moment else [])))
    degree = degrees_of(ids, edges, degrees)
    rows = _at(ends, found, "entity_id")
    rows = rows.filter(holds(F.col("as_of"), F.col("valid_from"), F.col("valid_to"))) if moment else rows
    # edges are counted before they are weighed
    per = rows.groupBy("question_id", "entity_id", "sim", "page_id").agg(F.count("*").alias("edges")).join(degree, "entity_id", "left")
    weight = scores.damped(F.col("sim"), F.coalesce("degree", F.lit(0))) * F.col("edges")
    return per.groupBy("question_id", "page_id").agg(F.round(F.sum(weight), 6).alias("weight"))


def entity_channel(questions: DataFrame, entities: DataFrame, edges: DataFrame, k: int, cap: int = 8, degrees: DataFrame | None = None) -> DataFrame:
    return top_k(entity_weights(seeds(questions, entities, cap), edges, degrees=degrees), ["question_id"], [F.col("weight").desc(), F.col("page_id")], k)


def expansion_weights(found: DataFrame, edges: DataFrame, depth: int = 2, kinds: list[str] | None = None, hub: int = scores.HUB_DEGREE, touched: DataFrame | None = None, degrees: DataFrame | None = None) -> DataFrame:
    """(question_id, page_id, weight) around what found entities lead to: both directions, sure edges of reasoning kinds, never
    through hubs. Each hop starts at the frontier; degrees are those of a kept table, or counted for what the hop reaches. What is
    found for a moment (as_of) walks edges of ``touched`` that held then: moments are a column, not a pass each."""
    from ..functions.kinds import WALKED

    walked, moment = edges if touched is None else touched, ["as_of"] if "as_of" in found.columns else []
    valid = VALID if moment else []
    sure = walked.filter((F.col("confidence") >= scores.MIN_CONFIDENCE) & F.col("kind").isin(kinds or WALKED)).select("from_id", "to_id", "confidence", *valid)
    both = sure.unionByName(sure.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "confidence", *valid))
    at = cut(found.select("question_id", *moment, "entity_id", F.col("sim").alias("mult"), F.array("entity_id").alias("path")))
    every = at
    for _ in range(depth):
        # of several edges between two entities the surest leads on: the best multiplier of a path is all that counts
        leave = _at(both, at.select(F.col("entity_id").alias("from_id"), *moment).distinct(), "from_id")
        leave = leave.filter(holds(F.col("as_of"), F.col("valid_from"), F.col("valid_to"))) if moment else leave
        leave = cut(leave.groupBy("from_id", "to_id", *moment).agg(F.max("confidence").alias("confidence")))
        degree = degrees_of(leave.select(F.col("to_id").alias("entity_id")), edges, degrees)
        open_ = leave.join(degree.withColumnRenamed("entity_id", "to_id"), "to_id").filter(F.col("degree") <= hub).select("from_id", "to_id", *[F.col(c).alias(f"_{c}") for c in moment], "confidence")
        same = F.col("as_of").eqNullSafe(F.col("_as_of")) if moment else F.lit(True)
        at = cut(
            open_.join(small(at), (F.col("from_id") == F.col("entity_id")) & same)
            .filter(~F.array_contains("path", F.col("to_id")))
            .select("question_id", *moment, F.col("to_id").alias("entity_id"), (F.col("mult") * F.col("confidence") * scores.HOP_DECAY).alias("mult"), F.concat("path", F.array("to_id")).alias("path"))
        )
        every = every.unionByName(at)
    best = cut(every.groupBy("question_id", *moment, "entity_id").agg(F.max("mult").alias("mult")))
    pages = page_weights(best, walked, F.col("mult"))
    return pages.withColumn("weight", F.round("weight", 6))


def expansion_channel(questions: DataFrame, entities: DataFrame, edges: DataFrame, k: int, cap: int = 5, depth: int = 2, kinds: list[str] | None = None, hub: int = scores.HUB_DEGREE, degrees: DataFrame | None = None) -> DataFrame:
    pages = expansion_weights(seeds(questions, entities, cap), edges, depth, kinds, hub, degrees=degrees)
    return top_k(pages, ["question_id"], [F.col("weight").desc(), F.col("page_id")], k)


def channel(df: DataFrame, name: str, item: str = "item_id") -> DataFrame:
    return df.select("question_id", F.col(item).alias("item_id"), F.lit(name).alias("channel"), "rank", F.lit(scores.WEIGHTS[name]).alias("weight"))


def rerank(results: DataFrame, score: Column, pool: int, limit: int) -> DataFrame:
    """The first ``pool`` results of each question by a reranker's score; ``score`` may be a plug-in's pandas UDF."""
    inside = results.filter(F.col("rank") <= pool).withColumn("rerank", score)
    return ranked(inside, ["question_id"], [F.col("rerank").desc(), F.col("rank")], "position").filter(F.col("position") <= limit)


def overlap(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the question's words that the text has."""
    q = F.array_distinct(words(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(text))), F.size(q)), F.lit(0.0))
