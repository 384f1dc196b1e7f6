"""Tables in partitions: what is purged or replaced touches its own files alone; readers see whole versions; degrees kept by changes."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, resolve
from palimpsest.operators.degrees import Degrees
from palimpsest.sources.versioned import Versioned


def files(df):
    return set(df.inputFiles())


def test_partitions_are_replaced_and_purged_alone(spark, tmp_path):
    rows = [(i, k, f"t{i}") for i, k in enumerate(["a", "b", "b", None, "c/d e", "a"])]
    df = spark.createDataFrame(rows, "id long, org string, text string")
    t = Versioned.create(df, str(tmp_path / "t"), "org")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(t.read()) == set(rows) and t.read().columns == df.columns
    before = {v: files(t.read([v])) for v in ("a", "b", None, "c/d e")}
    assert all(before.values()) and sum(map(len, before.values())) == len(files(t.read()))
    assert as_set(t.read(["a", None])) == {r for r in rows if r[1] in ("a", None)}
    t.overwrite(spark.createDataFrame([(9, "b", "new")], df.schema))
    assert as_set(t.read(["b"])) == {(9, "b", "new")}
    assert all(files(t.read([v])) == before[v] for v in ("a", None, "c/d e")) and files(t.read(["b"])).isdisjoint(before["b"])
    old = t.read(version=1)
    t.purge(["a", "nobody"])
    assert as_set(t.read()) == {(9, "b", "new"), rows[3], rows[4]} and t.read(["a"]).count() == 0
    # a reader of an earlier version still has it, until it is cleared away
    assert as_set(old) == set(rows)
    gone = t.vacuum()
    assert len(gone) == 2 and t.versions() == [3]
    assert as_set(t.read()) == {(9, "b", "new"), rows[3], rows[4]} and as_set(Versioned(spark, str(tmp_path / "t"), "org").read(["c/d e"])) == {rows[4]}
    t.overwrite(t.read().limit(0), values=["b"])
    assert as_set(t.read()) == {rows[3], rows[4]}


def test_a_write_that_fails_leaves_the_version_before(spark, tmp_path):
    t = Versioned.create(spark.range(5).withColumn("k", F.col("id") % 2), str(tmp_path / "t"), "k")
    with pytest.raises(Exception, match="no luck"):
        t.overwrite(spark.range(9).withColumn("k", F.when(F.col("id") == 7, F.raise_error(F.lit("no luck")).cast("long")).otherwise(F.col("id") % 2)))
    assert t.read().count() == 5 and t.versions() == [1]
    # another writer that made the same version is not overwritten
    other = Versioned(spark, str(tmp_path / "t"), "k")
    other.purge([0])
    t.versions = lambda: [1]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        t.purge([1])
    assert {r.id for r in other.read().collect()} == {1, 3}


def test_a_table_without_rows(spark, tmp_path):
    t = Versioned.create(spark.range(0).withColumn("k", F.col("id")), str(tmp_path / "t"), "k")
    assert t.read().count() == 0 and t.read().columns == ["id", "k"]
    t.overwrite(spark.range(3).withColumn("k", F.col("id")))
    assert t.read([1, 5]).count() == 1


def test_degrees_follow_any_sequence_of_changes(spark, tmp_path):
    edges = lambda rows: spark.createDataFrame(rows, "from_id long, to_id long")
    now = [(1, 2), (1, 2), (2, 2), (3, 4), (4, 1), (5, 6)]
    kept = Degrees.start(edges(now), str(tmp_path / "d"), buckets=5)

    def check():
        want = {r.entity_id: r.degree for r in graph.degree(edges(now)).collect()} if now else {}
        assert {r.entity_id: r.degree for r in kept.read().collect()} == want

    check()
    kept.apply(edges([(6, 7), (1, 2)]), edges([(3, 4), (2, 2)]))
    now = [(1, 2), (1, 2), (4, 1), (5, 6), (6, 7), (1, 2)]
    check()
    # 2 becomes 1: edges between them are loops and go; 7 becomes 5
    kept.merge(spark.createDataFrame([(1, 1), (2, 1), (7, 5)], "entity_id long, canonical_id long"), edges(now))
    now = [(4, 1), (5, 6), (6, 5)]
    check()
    before = {p: x for p, x in kept.table.manifest().items()}
    kept.apply(edges([(8, 8)]))
    now.append((8, 8))
    check()
    after = kept.table.manifest()
    assert sum(after[p] != before.get(p) for p in after) == 1
    kept.apply(closed=edges(now))
    now = []
    check()


def test_json_is_merged_key_by_key(spark):
    rows = [(1, 0, '{"a": 1, "b": {"x": [1, 2]}, "q": "it\\"s"}'), (1, 1, '{"a": null, "c d.e": true}'), (2, 0, None), (3, 0, "[1]"), (3, 1, "no json"), (4, 2, '{"z": 1}'), (4, 1, '{"z": {"z": 2}}')]
    df = spark.createDataFrame(rows, "id int, r int, j string")
    got = {r.id: json.loads(r.j) for r in graph.merge_json(df, ["id"], "j", F.struct(-F.col("r"))).collect()}
    assert got == {1: {"a": None, "b": {"x": [1, 2]}, "c d.e": True, "q": 'it"s'}, 2: {}, 3: {}, 4: {"z": 1}}
    # the canonical one's before its duplicates'
    got = {r.id: json.loads(r.j) for r in graph.merge_json(df, ["id"], "j", F.struct("r")).collect()}
    assert got[1]["a"] == 1 and got[4] == {"z": {"z": 2}}


def test_aliases_of_very_many_rows_are_made_distinct_first(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.array(F.concat(F.lit("a"), (F.col("id") % 3).cast("string")), F.lit("b")).alias("aliases"))
    got = resolve.upsert_entities(rows, ["key"], "seq").collect()
    assert [(r.name, r.aliases) for r in got] == [("n19999", ["a0", "a1", "a2", "b"])]
