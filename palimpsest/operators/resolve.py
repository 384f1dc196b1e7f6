"""Entity hygiene: sanitising, similar names, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kinds, scores, text
from .joins import lookup
from .state import cut


def sanitize_entities(raw: DataFrame) -> DataFrame:
    """Trimmed names, known kinds; of equal slugs the first by id; nameless ones go."""
    clean = raw.withColumn("name", F.trim("name")).filter("name <> ''").withColumn("kind", kinds.entity_kind(F.col("kind"))).withColumn("slug", text.normalize(F.col("name")))
    first = Window.partitionBy("slug").orderBy("id")
    return clean.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def sanitize_edges(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (a, b, kind, weight) between known entities (id), no loops, canonical kinds, weight 1 by default."""
    inner = raw.filter("a <> b").join(known, raw.a == known.id, "left_semi").join(known, F.col("b") == known.id, "left_semi")
    return inner.withColumn("kind", kinds.edge_kind(F.col("kind"))).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def numbers(name: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)))


def similar_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, sim) of names (id, kind, name) of one kind, equal numbers and trigram similarity.

    Blocked by a prefix of each name's trigrams, rarest first: names above the threshold share one of the first
    n - ceil(threshold * n) + 1. So common trigrams, which all names have, hardly ever meet."""
    ids = cut(names.select("id", "kind", "name"))
    classes, links = similar_classes(ids, threshold)
    members = ids.select("id", *_class_key()).join(classes.select("kind", "nums", "t", "rep"), ["kind", "nums", "t"])
    member = members.select("id", "rep")
    of = lambda x: member.select(F.col("id").alias(x), F.col("rep").alias(f"r{x}"))
    across = links.join(of("x"), links.a == F.col("rx")).join(of("y"), links.b == F.col("ry")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")
    inside = of("a").join(of("b"), F.col("ra") == F.col("rb")).filter("a < b").select("a", "b", F.lit(1.0).alias("sim"))
    return across.unionByName(inside)


def _class_key() -> list[Column]:
    return [F.col("kind"), numbers(F.col("name")).alias("nums"), F.array_sort(scores.trigrams(F.col("name"))).alias("t")]


def similar_classes(names: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Names (id, kind, name) grouped by kind, numbers and trigrams, (kind, nums, t, rep, n), rep their least id; and links
    (a, b, sim) between reps at the threshold. However many names are alike, a class is compared once."""
    classes = names.select("id", *_class_key()).filter("size(t) > 0").groupBy("kind", "nums", "t").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = cut(classes)
    one = classes.select("rep", "kind", "nums", F.size("t").alias("n"), F.explode("t").alias("g"))
    common = one.groupBy("g").agg(F.count("*").alias("df"))
    order = Window.partitionBy("rep").orderBy("df", "g")
    prefix = one.join(common, "g").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1)
    # equal numbers are part of the key, as they must agree anyway
    a, b = (prefix.select(F.col("rep").alias(x), "kind", "nums", "g") for x in ("a", "b"))
    met = a.join(b, ["kind", "nums", "g"]).filter("a < b").select("a", "b").distinct()
    of = lambda x: classes.select(F.col("rep").alias(x), F.col("t").alias(f"t{x}"))
    both = met.join(of("a"), "a").join(of("b"), "b")
    n = F.size(F.array_intersect("ta", "tb"))
    sim = F.round(n / (F.size("ta") + F.size("tb") - n), 9)
    return classes, both.select("a", "b", sim.alias("sim")).filter(F.col("sim") >= threshold)


def similar_links(names: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) with the components of ``similar_pairs``: classes by their reps, members to their own rep, so that names
    that are alike are a star and not all pairs."""
    ids = cut(names.select("id", "kind", "name"))
    classes, links = similar_classes(ids, threshold)
    star = lookup(ids.select("id", F.xxhash64(*_class_key()).alias("key")), cut(classes.select(F.xxhash64("kind", "nums", "t").alias("key"), "rep", "n")), ["key"], "n", ids.count(), ["id"])
    return links.select("a", "b").unionByName(star.filter("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")))


def upsert_entities(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the latest name, the union of all aliases."""
    rows = cut(rows)
    # aliases are made distinct before they are collected
    each = rows.select(*key, F.explode_outer("aliases").alias("_alias")).distinct()
    aliases = each.groupBy(*key).agg(F.array_sort(F.collect_list("_alias")).alias("aliases"))
    return rows.groupBy(*key).agg(F.max_by("name", order).alias("name")).join(aliases, key)


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``new`` over ``old`` by key: of each key the row that is last by ``order``."""
    last = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return old.unionByName(new).withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
