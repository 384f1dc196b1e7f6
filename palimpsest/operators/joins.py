"""Joins and components that no hot key can skew, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import cut_round

#: A key is hot above this share of all rows, so at most as many keys are hot: a bound for broadcasts.
HOT_SHARE = 1000
#: Rows that are broadcast at most, where a side is counted first.
MOST = 100_000
#: Rows that a task sorts or groups, about; tasks beyond which they grow to ``GROWN`` rows first, as Spark sorts what it writes for
#: more of them (spark.shuffle.sort.bypassMergeThreshold).
TASK, TASKS, GROWN = 300_000, 200, 1_200_000
#: One row in so many tells which keys are dealt to several tasks; results don't depend on that.
TOLD = 100


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which is counted; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks share ``rows`` rows, so that what one of them holds doesn't grow with the tables; 0 where Spark's own tasks
    have no more, as a core has one such task at most."""
    parts = max(min(-(-rows // TASK), TASKS), -(-rows // GROWN))
    return parts if parts > spark.sparkContext.defaultParallelism else 0


def meet(big: DataFrame, few: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    """``big``, of about ``rows`` rows, joined with ``few`` (inner or left) in ``tasks`` of bounded size. A key with more rows of
    ``big`` than a task is dealt to several, to each of which its rows of ``few`` go."""
    parts = tasks(big.sparkSession, rows)
    if not parts:
        return big.join(few, key, how)
    deal, salt = (fresh(big, fresh(few, c)) for c in ("_deal", "_salt"))
    each = -(-rows // parts)
    some = big.select(key).sample(1 / TOLD, seed=1).groupBy(key).agg(F.ceil(F.count("*") * TOLD / each).cast("int").alias(deal))
    hot = cut_round(some.filter(F.col(deal) > 1))  # as many as there are tasks, about
    if hot.isEmpty():
        return big.repartition(parts, key).join(few, key, how)
    hot, to = F.broadcast(hot), F.coalesce(deal, F.lit(1))
    left = big.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), to).cast("int")).drop(deal)
    right = few.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), to - 1))).drop(deal)
    return left.repartition(parts, key, salt).join(right, [key, salt], how).drop(salt)


def lookup(big: DataFrame, few: DataFrame, keys: list[str], weight: str, total: int, spread: list[str], shuffled: bool = False) -> DataFrame:
    """Left join on ``keys``, unique in ``few``, that no hot key can skew.

    Keys with more than a ``HOT_SHARE``th of ``total`` rows (``weight`` counts a key's rows in ``big``, ``total`` their
    sum, so there are at most ``HOT_SHARE`` such keys) are broadcast. The rest is shuffled; rows that already found
    their key are dealt by ``spread`` instead. ``few`` should be cut: it is read twice. Null keys match nothing.
    ``shuffled``: other keys aren't broadcast however few they are, for loops, whose rounds would add up at the driver.
    """
    limit = max(total // HOT_SHARE, 10_000)
    values = [c for c in few.columns if c not in keys]
    hot_, cold_, salt = (fresh(big, x) for x in ("_hot", "_cold", "_salt"))
    hot = few.filter(F.col(weight) > limit).select(*keys, F.struct(*values).alias(hot_))
    cold = few.filter(F.col(weight) <= limit).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*values).alias(cold_), F.lit(0).cast("long").alias(salt))
    own = big.columns
    rows = big.join(F.broadcast(hot), keys, "left")
    dealt = F.when(F.col(hot_).isNull() & F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)), F.lit(0).cast("long")).otherwise(F.xxhash64(*[F.col(c) for c in spread]).bitwiseOR(F.lit(1).cast("long")))
    rows = rows.withColumn(salt, dealt)
    on = [F.col(f"a.`{k}`") == F.col(f"b._k{i}") for i, k in enumerate(keys)]
    out = rows.alias("a").join((cold.hint("merge") if shuffled else cold).alias("b"), [*on, F.col(f"a.{salt}") == F.col(f"b.{salt}")], "left")
    found = F.coalesce(F.col(hot_), F.col(cold_))
    return out.select(*[F.col(f"a.`{c}`") for c in own], *[found[v].alias(v) for v in values])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of the component.

    Contraction: each round every node joins its first neighbour, if that comes before itself, and links are rewritten to
    what was joined; links within a group vanish. First is by number in odd rounds, in which stars collapse, and by a hash,
    another each time, in even ones: in a random order a constant share of the nodes with links is expected to go, in chains
    too. So rounds grow with the logarithm of the nodes. Each round is cut, so nothing is lost with an executor, and nothing
    goes to the driver but counts. A node of any degree, and a root of any number of nodes, is met by ``lookup``.
    """
    edges = cut_round(edges.select("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = cut_round(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    nodes, total, turn = roots.count(), edges.count(), 0
    while total:
        turn += 1
        place = lambda c: F.col(c) if turn % 2 else F.xxhash64(F.col(c), F.lit(turn))  # noqa: E731, B023
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min_by("b", place("b")).alias("b"), F.count("*").alias("n"))
        low = cut_round(first.select("a", F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("low"), "n"))
        step = lambda df, k: lookup(df, low.select(F.col("a").alias(k), F.col("low").alias(f"{k}_low"), "n"), [k], "n", 2 * total, df.columns).drop("n")  # noqa: E731, B023
        moved = step(step(edges, "a"), "b").select(F.least("a_low", "b_low").alias("a"), F.greatest("a_low", "b_low").alias("b"))
        edges = cut_round(moved.filter("a <> b").distinct())
        # a root of any number of nodes is met by its own count
        own = roots.groupBy("root").agg(F.count("*").alias("m")).join(low.select(F.col("a").alias("root"), F.col("low").alias("root_low")), "root")
        roots = cut_round(lookup(roots, cut_round(own), ["root"], "m", nodes, ["node"]).select("node", F.coalesce("root_low", "root").alias("root")))
        total = edges.count()
    least = cut_round(roots.groupBy("root").agg(F.min("node").alias("least"), F.count("*").alias("m")))
    return lookup(roots, least, ["root"], "m", nodes, ["node"]).select("node", F.col("least").alias("root"))
