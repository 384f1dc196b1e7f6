"""Scans: the tables as they are, and the memory model built on them (pages, chunks, entities, edges, usage)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.joins import meet, tasks

PERSON, ORGANIZATION, PART, NATION, REGION = 1_000_000_000, 3_000_000_000, 5_000_000_000, 7_000_000_000, 8_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class TenantScope:
    """Every table that is read through it is filtered to one organization; the filter reaches the scan."""

    def __init__(self, organization_id: int):
        self.organization_id = organization_id

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("organization_id") == self.organization_id)


def current(df: DataFrame) -> DataFrame:
    return df.filter(F.col("valid_to").isNull())


def as_of(df: DataFrame, moment) -> DataFrame:
    """The snapshot at ``moment`` (a Column or a literal); intervals are half open."""
    t = moment if not isinstance(moment, str) else F.lit(moment).cast("timestamp")
    return df.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def hours_after_start(n):
    return F.timestamp_seconds(F.lit(1704067200) + n * 3600)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    created = hours_after_start(F.col("doc_id"))
    return d.select(
        F.col("doc_id").alias("page_id"),
        (F.col("doc_id") % 3).alias("organization_id"),
        F.col("source").alias("domain"),
        F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("project"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(": "), F.substring("text", 1, 12)).alias("title"),
        F.col("text").alias("content"),
        created.alias("created_at"),
        created.alias("valid_from"),
        F.when(F.col("doc_id") % 10 == 7, hours_after_start(F.col("doc_id") + 100)).alias("valid_to"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, key, label, base, kind: table(spark, sf_dir, name).select((F.col(key).cast("long") + base).alias("entity_id"), F.col(label).alias("name"), F.lit(kind).alias("kind"))
    every = of("customer", "c_custkey", "c_name", PERSON, "person")
    for x in (("supplier", "s_suppkey", "s_name", ORGANIZATION, "organization"), ("part", "p_partkey", "p_name", PART, "concept"), ("nation", "n_nationkey", "n_name", NATION, "place"), ("region", "r_regionkey", "r_name", REGION, "place")):
        every = every.unionByName(of(*x))
    return every.withColumn("slug", tx.normalize(F.col("name")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is where, what a customer uses (from the order's date), on which supplier a part depends."""
    id_of = lambda c, base: F.col(c).cast("long") + base
    none, start = F.lit(None).cast("timestamp"), F.lit("1995-01-01").cast("timestamp")

    def shaped(df: DataFrame, a, b, kind: str, valid_from=start, score=F.lit(1.0), page=F.lit(None).cast("long")) -> DataFrame:
        return df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"), score.alias("confidence"), valid_from.alias("valid_from"), none.alias("valid_to"), page.alias("page_id"))

    c, s, n = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    rows = line.count()
    sold = meet(line, order, "l_orderkey", rows)
    score = F.element_at(F.array(F.lit(1.0), F.lit(0.7), F.lit(0.4)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    # hardly two lines have the same pair, so they are dealt before they are grouped, where they are many
    few = tasks(spark, rows)
    parts = (line.repartition(few, "l_partkey", "l_suppkey") if few else line).groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("page"))
    return (
        shaped(c, id_of("c_custkey", PERSON), id_of("c_nationkey", NATION), "located_in")
        .unionByName(shaped(s, id_of("s_suppkey", ORGANIZATION), id_of("s_nationkey", NATION), "located_in"))
        .unionByName(shaped(n, id_of("n_nationkey", NATION), id_of("n_regionkey", REGION), "part_of"))
        .unionByName(shaped(sold, id_of("o_custkey", PERSON), id_of("l_partkey", PART), "uses", F.col("o_orderdate"), score, F.col("l_orderkey")))
        .unionByName(shaped(parts, id_of("l_partkey", PART), id_of("l_suppkey", ORGANIZATION), "depends_on", page=F.col("page")))
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("organization_id"), F.col("user_id").alias("agent_id"), F.col("event_type").alias("metric"), "ts", "value", "props")



#: CTEs that build the same model in SQL.
PAGES_SQL = """pages_ AS (SELECT doc_id AS page_id, doc_id % 3 AS organization_id, source AS domain, CASE WHEN doc_id % 4 <> 0 THEN lang END AS project,
  'Doc ' || doc_id || ': ' || substr(text, 1, 12) AS title, text AS content, TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS created_at,
  TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS valid_from, CASE WHEN doc_id % 10 = 7 THEN TIMESTAMP '2024-01-01' + to_hours((doc_id + 100)::INT) END AS valid_to FROM documents)"""
ENTITIES_SQL = """entities AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (
  SELECT c_custkey + 1000000000 AS entity_id, c_name AS name, 'person' AS kind FROM customer
  UNION ALL SELECT s_suppkey + 3000000000, s_name, 'organization' FROM supplier
  UNION ALL SELECT p_partkey + 5000000000, p_name, 'concept' FROM part
  UNION ALL SELECT n_nationkey + 7000000000, n_name, 'place' FROM nation
  UNION ALL SELECT r_regionkey + 8000000000, r_name, 'place' FROM region))"""
EDGES_SQL = """edges AS (
  SELECT c_custkey + 1000000000 AS from_id, c_nationkey + 7000000000 AS to_id, 'located_in' AS kind, 1.0::DOUBLE AS confidence, TIMESTAMP '1995-01-01' AS valid_from, NULL::TIMESTAMP AS valid_to, NULL::BIGINT AS page_id FROM customer
  UNION ALL SELECT s_suppkey + 3000000000, s_nationkey + 7000000000, 'located_in', 1.0, TIMESTAMP '1995-01-01', NULL, NULL FROM supplier
  UNION ALL SELECT n_nationkey + 7000000000, n_regionkey + 8000000000, 'part_of', 1.0, TIMESTAMP '1995-01-01', NULL, NULL FROM nation
  UNION ALL SELECT o_custkey + 1000000000, l_partkey + 5000000000, 'uses', [1.0, 0.7, 0.4][(l_linenumber % 3) + 1]::DOUBLE, o_orderdate, NULL, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT l_partkey + 5000000000, l_suppkey + 3000000000, 'depends_on', 1.0, TIMESTAMP '1995-01-01', NULL, min(l_orderkey) FROM lineitem GROUP BY l_partkey, l_suppkey)"""
