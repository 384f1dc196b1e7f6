"""The bi-temporal entity graph: degrees, traversal, supersede history, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.kinds import ONE_TO_ONE
from .joins import components, lookup, small
from .state import cut


def endpoints(edges: DataFrame) -> DataFrame:
    """A row for each end of each edge: the equi-join form of a join on either end. A loop has one row."""
    return edges.withColumn("entity_id", F.explode(F.array_distinct(F.array("from_id", "to_id"))))


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``endpoints`` at the given entities (entity_id)."""
    return endpoints(edges.select("from_id", "to_id")).join(ids, "entity_id", "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    """Edges at each entity, over edges or rows of ``endpoints``."""
    rows = edges if "entity_id" in edges.columns else endpoints(edges.select("from_id", "to_id"))
    return rows.groupBy("entity_id").agg(F.count("*").alias("degree"))


def traverse(seeds: DataFrame, edges: DataFrame, depth: int = 2, kinds: list[str] | None = None, max_results: int = 100, entities: DataFrame | None = None) -> DataFrame:
    """Everything within ``depth`` hops along edges from ``seeds`` (seed_id): (seed_id, entity_id, edge_kind, weight, path,
    depth) of the shortest simple path, of several the one whose last edge weighs most. A seed's loop to itself is a hop.

    With ``entities`` (entity_id, slug) also path_slugs. Depth is bounded, so the hops are that many joins; each starts at
    the frontier, so only edges that leave it are grouped, and is cut. What a hop found already is not walked again."""
    depth = max(1, min(depth, 5))
    walk = (edges.filter(F.col("kind").isin(kinds)) if kinds else edges).select("from_id", "to_id", "kind", "confidence")
    at = seeds.select("seed_id", F.col("seed_id").alias("entity_id"), F.array(F.col("seed_id")).alias("path"))
    found = None
    for d in range(1, depth + 1):
        near = at.select(F.col("entity_id").alias("from_id")).distinct()
        out = walk.join(small(near), "from_id", "left_semi").groupBy("from_id", "to_id", "kind").agg(F.max("confidence").alias("weight"))
        hop = at.join(out, F.col("entity_id") == F.col("from_id"))
        if d > 1:
            hop = hop.filter(~F.array_contains("path", F.col("to_id")))
        hop = hop.select("seed_id", F.col("to_id").alias("entity_id"), F.col("kind").alias("edge_kind"), "weight", F.concat("path", F.array("to_id")).alias("path"), F.lit(d).alias("depth"))
        if found is not None:
            hop = hop.join(found.select("seed_id", "entity_id"), ["seed_id", "entity_id"], "left_anti")
        # of a group the first by weight, kind and path, which combines before the shuffle
        best = hop.groupBy("seed_id", "entity_id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "edge_kind", "path", "depth")).alias("x"))
        hop = cut(best.select("seed_id", "entity_id", "x.edge_kind", (-F.col("x.w")).alias("weight"), "x.path", "x.depth"))
        found = hop if found is None else found.unionByName(hop)
        at = hop.select("seed_id", "entity_id", "path")
    first = Window.partitionBy("seed_id").orderBy("depth", "entity_id")
    found = found.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= max_results).drop("_r")
    if entities is None:
        return found
    steps = found.select("seed_id", "entity_id", F.posexplode("path").alias("k", "id")).join(entities.select(F.col("entity_id").alias("id"), "slug"), "id")
    slugs = steps.groupBy("seed_id", "entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "slug"))), lambda x: x["slug"]).alias("path_slugs"))
    return found.join(slugs, ["seed_id", "entity_id"], "left")


def supersede(facts: DataFrame) -> DataFrame:
    """The history of facts (from_id, kind, to_id, seq, valid_at, invalid_at): for kinds with one value at a time, a fact
    closes when the next with another value arrives, at that one's valid time; repeats of a value close with it."""
    one = F.col("kind").isin(ONE_TO_ONE)
    own = Window.partitionBy("from_id", "kind").orderBy("seq")
    island = F.sum(F.when(F.lag("to_id").over(own).eqNullSafe(F.col("to_id")), 0).otherwise(1)).over(own)
    marked = facts.withColumn("_island", island).withColumn("_start", F.first("valid_at").over(Window.partitionBy("from_id", "kind", "_island").orderBy("seq")))
    # the first fact of the next run of equal values closes this run
    after = Window.partitionBy("from_id", "kind").orderBy("_island").rangeBetween(1, 1)
    closed = F.coalesce("invalid_at", F.when(one, F.first("_start").over(after)))
    return marked.withColumn("valid_to", closed).drop("_island", "_start")


def persist(entities: DataFrame, edges: DataFrame, new_entities: DataFrame, new_edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What an extraction adds to a graph: (entities (slug, kind, name, aliases, and attributes if both sides have them), edges
    (from_slug, to_slug, kind, weight, confidence, score, page_id, valid_from, valid_to)).

    A known slug keeps its kind and name and gains aliases; its attributes are merged key by key, what is new before what is stored. Of edges of a batch whose kind has one value at a time the last
    by seq counts; it closes open ones to other entities at its valid time, or ``now``. Edges to unknown entities go; all
    others are added, also where there is one like it, as that is history. New edges: (from_slug, to_slug, kind, weight,
    state, score, page_id, seq, valid_at, invalid_at)."""
    more = ["attributes"] if "attributes" in entities.columns and "attributes" in new_entities.columns else []
    named = lambda df, rank: df.filter("slug <> ''").select("slug", "kind", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), *more, F.lit(rank).alias("r"))
    every = cut(named(entities, 0).unionByName(named(new_entities, 1)))
    first = F.min_by(F.struct("kind", "name"), F.struct("r", "name")).alias("x")
    merged = every.groupBy("slug").agg(first).select("slug", "x.kind", "x.name").join(union_of(every, "slug", "aliases"), "slug")
    if more:
        merged = merged.join(merge_json(every, ["slug"], "attributes", F.struct(-F.col("r"), "name", "attributes")), "slug", "left")
    known = new_entities.select("slug").distinct()
    one = F.col("kind").isin(ONE_TO_ONE)
    last = Window.partitionBy("from_slug", "kind").orderBy(F.desc("seq"))
    fresh = new_edges.withColumn("_r", F.when(one, F.row_number().over(last)).otherwise(1)).filter("_r = 1")
    fresh = fresh.join(known, fresh.from_slug == known.slug, "left_semi").join(known, F.col("to_slug") == known.slug, "left_semi")
    sure = scores.confidence(F.col("state"), F.col("score"))
    added = fresh.select("from_slug", "to_slug", "kind", "weight", sure["state"].alias("confidence"), sure["score"].alias("score"), "page_id", F.coalesce("valid_at", now).alias("valid_from"), F.col("invalid_at").alias("valid_to"))
    closing = fresh.filter(one).select("from_slug", "kind", F.col("to_slug").alias("_to"), F.coalesce("valid_at", now).alias("_at"))
    old = edges.join(closing, ["from_slug", "kind"], "left")
    closed = F.when(F.col("valid_to").isNull() & F.col("_to").isNotNull() & (F.col("_to") != F.col("to_slug")), F.col("_at")).otherwise(F.col("valid_to"))
    return merged, old.withColumn("valid_to", closed).select(*added.columns).unionByName(added)


def union_of(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, values) with each value of the key's arrays once, in order: repeats are dropped before they are collected."""
    one = df.select(key, F.explode_outer(values).alias("_v")).distinct()
    return one.groupBy(key).agg(F.array_sort(F.collect_list("_v")).alias(values))


def merge_json(df: DataFrame, by: list[str], column: str, order: Column) -> DataFrame:
    """(by, column): the JSON objects of each group as one, key by key that of the lowest ``order`` that has the key, keys sorted.
    Values stay whole, nested ones too; what is no object has no keys, a group without keys is {}."""
    keys = df.select(*by, order.alias("_order"), F.explode_outer(F.from_json(column, "map<string,variant>")).alias("_key", "_value"))
    best = keys.withColumn("_value", F.to_json("_value")).groupBy(*by, "_key").agg(F.min_by("_value", "_order").alias("_value"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("_key").isNotNull(), F.struct("_key", "_value")))).alias("_pairs")
    whole = F.map_from_arrays(F.col("_pairs._key"), F.transform("_pairs._value", lambda v: F.parse_json(F.coalesce(v, F.lit("null")))))
    return best.groupBy(*by).agg(pairs).select(*by, F.to_json(whole).alias(column))


def least_label(pairs: DataFrame) -> DataFrame:
    """Connected components of pairs (a, b): (id, label), the least id of the component, for chains of any length."""
    loops = pairs.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    found = components(pairs).select(F.col("node").alias("id"), F.col("root").alias("label"))
    return found.unionByName(loops.join(found, "id", "left_anti"))


def resolve(entities: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges entities that ``pairs`` connect: (map of entity_id to canonical_id, rewritten edges without loops).

    Canonical is the member with most edges, then the least id."""
    label = cut(least_label(pairs))
    d = degree(touching(edges, label.select(F.col("id").alias("entity_id"))))
    member = label.join(d, label.id == d.entity_id, "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
    best = member.groupBy("label").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("x"), F.count("*").alias("n"))
    # a component of any size is looked up, and so is an entity of any degree
    names = lookup(member, cut(best.select("label", F.col("x.id").alias("canonical_id"), "n")), ["label"], "n", label.count(), ["id"])
    names = cut(names.select(F.col("id").alias("entity_id"), "canonical_id", F.greatest("degree", F.lit(1)).alias("degree")))
    total = 2 * edges.count()

    def to(df: DataFrame, c: str) -> DataFrame:
        few = names.select(F.col("entity_id").alias(c), F.col("canonical_id").alias("_c"), "degree")
        return lookup(df, few, [c], "degree", total, ["from_id", "to_id"]).withColumn(c, F.coalesce("_c", c)).drop("_c", "degree")

    return names.drop("degree"), to(to(edges, "from_id"), "to_id").filter("from_id <> to_id")
