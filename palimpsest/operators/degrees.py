"""Degrees of entities as a kept table: changed by what edges come and go, never recounted.

The table (entity_id, degree) lies in buckets of entities (``sources.versioned``). A change of the graph, edges opened, closed or
moved by a merge, becomes a change of degree for each of their ends; only the buckets that these touch are read and written anew.
Degrees are of current edges, a loop counts once, entities without edges have no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import Versioned
from . import graph
from .joins import small
from .state import cut_round

BUCKETS = 64


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int"))


def changes(opened: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """(entity_id, change) of edges (from_id, to_id) that came and that went."""
    ends = lambda df, by: graph.endpoints(df.select("from_id", "to_id")).select("entity_id", F.lit(by).cast("long").alias("change"))
    parts = [ends(df, by) for df, by in ((opened, 1), (closed, -1)) if df is not None]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("entity_id").agg(F.sum("change").alias("change")).filter("change <> 0")


class Degrees:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.table, self.buckets = Versioned(spark, path, "bucket"), buckets

    @classmethod
    def start(cls, edges: DataFrame, path: str, buckets: int = BUCKETS) -> Degrees:
        """Counts ``edges``, once."""
        Versioned.create(_bucketed(graph.degree(edges), buckets), path, "bucket")
        return cls(edges.sparkSession, path, buckets)

    def read(self) -> DataFrame:
        return self.table.read().select("entity_id", "degree")

    def apply(self, opened: DataFrame | None = None, closed: DataFrame | None = None) -> None:
        """Edges that came and edges that went; one that moved is both. An edge that went must have been counted."""
        new = cut_round(_bucketed(changes(opened, closed), self.buckets))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        if touched:
            rows = self.table.read(touched).unionByName(new.withColumnRenamed("change", "degree"))
            self.table.overwrite(rows.groupBy("entity_id", "bucket").agg(F.sum("degree").alias("degree")).filter("degree > 0").select("entity_id", "degree", "bucket"), touched)

    def merge(self, names: DataFrame, edges: DataFrame) -> None:
        """Entities became others (entity_id, canonical_id): current ``edges``, as they were, are counted at their new ends, loops no
        more. Only edges at entities with a new name are looked at."""
        moved = names.filter("entity_id <> canonical_id")
        ids = moved.select("entity_id")
        hit = graph.endpoints(edges.select("from_id", "to_id").withColumn("_e", F.monotonically_increasing_id())).join(small(ids), "entity_id", "left_semi")
        old = cut_round(hit.select("_e", "from_id", "to_id").distinct())
        to = lambda df, c: df.join(small(moved.select(F.col("entity_id").alias(c), F.col("canonical_id").alias("_c"))), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
        self.apply(to(to(old, "from_id"), "to_id").filter("from_id <> to_id"), old)
