"""The archive format: round trips, files left out by the key, writes that fail, batches that are written again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import archive
from palimpsest.streaming import jobs


def kept(path):
    return sorted(os.listdir(f"{path}/files")) if os.path.isdir(f"{path}/files") else []


def test_documents_come_back(spark, sf_dir, tmp_path):
    archive.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = str(tmp_path / "a")
    docs.repartitionByRange(4, "doc_id").write.format(archive.NAME).mode("append").option("key", "doc_id").save(path)
    back = spark.read.format(archive.NAME).load(path)
    assert back.schema.simpleString() == docs.schema.simpleString()
    assert back.exceptAll(docs).count() == 0 == docs.exceptAll(back).count()
    assert len(kept(path)) == 4 == back.rdd.getNumPartitions()
    # a filter on the key leaves files out
    some = back.filter("doc_id BETWEEN 10 AND 20")
    assert some.rdd.getNumPartitions() == 1 and some.count() == docs.filter("doc_id BETWEEN 10 AND 20").count()
    assert back.filter("doc_id IN (0, 199)").rdd.getNumPartitions() == 2 and back.filter("doc_id > 100000").count() == 0
    assert back.filter("lang = 'en'").count() == docs.filter("lang = 'en'").count()
    docs.limit(3).write.format(archive.NAME).mode("overwrite").option("key", "doc_id").save(path)
    assert spark.read.format(archive.NAME).load(path).count() == 3


def test_nested_values_and_nulls(spark, tmp_path):
    archive.register(spark)
    rows = [(1, "a\nb é", [1.0, None], (None, [("x", True)])), (None, None, None, None), (3, "", [], ("s", []))]
    df = spark.createDataFrame(rows, "id long, s string, v array<double>, t struct<a: string, b: array<struct<c: string, d: boolean>>>")
    df.write.format(archive.NAME).mode("append").option("key", "id").save(str(tmp_path / "a"))
    assert {str(r) for r in spark.read.format(archive.NAME).load(str(tmp_path / "a")).collect()} == {str(r) for r in df.collect()}
    with pytest.raises(Exception, match="no columns of timestamp"):
        spark.range(1).select(F.current_timestamp().alias("t")).write.format(archive.NAME).mode("append").save(str(tmp_path / "b"))


def test_a_write_that_fails_leaves_nothing_that_is_seen(spark, tmp_path):
    archive.register(spark)
    path = str(tmp_path / "a")
    spark.range(5).write.format(archive.NAME).mode("append").save(path)
    before = kept(path)
    bad = spark.range(0, 1000, 1, 4).withColumn("id", F.when(F.col("id") == 900, F.raise_error(F.lit("no luck")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no luck"):
        bad.write.format(archive.NAME).mode("append").save(path)
    assert spark.read.format(archive.NAME).load(path).count() == 5
    assert len(os.listdir(f"{path}/manifests")) == 1 and set(before) <= set(kept(path))


def test_a_stream_writes_batches_that_replace_themselves(spark, tmp_path):
    archive.register(spark)
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    path, check = str(tmp_path / "a"), str(tmp_path / "check")

    def go():
        s = jobs.stream(spark, f"{tmp_path}/in", 1)
        s.writeStream.format(archive.NAME).option("path", path).option("key", "id").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    go()
    assert {r.id for r in spark.read.format(archive.NAME).load(path).collect()} == set(range(30))
    assert [len(json.loads(open(f"{path}/manifests/{n}").read())["files"]) for n in sorted(os.listdir(f"{path}/manifests"))] == [1, 1, 1]
    # the last batch is forgotten by the engine, as if it had failed after the write: it is written again and counts once
    os.remove(f"{check}/commits/2")
    crc = f"{check}/commits/.2.crc"
    if os.path.exists(crc):
        os.remove(crc)
    go()
    assert sorted(r.id for r in spark.read.format(archive.NAME).load(path).collect()) == list(range(30))


def test_wiki_documents_have_titles_as_they_stand(spark, tmp_path):
    import duckdb
    from conftest import same

    from palimpsest import registry

    rows = [(2, 'say "x" a\\b', "en", "src1", 9), (5, ' "', "fr", "wiki", 2), (8, "plain", None, "src2", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = registry.oracle_sql()["wiki_documents"]
    got = registry.queries()["wiki_documents"](spark, str(tmp_path))
    # the SQL's domains are all memories, its paths keep backslashes
    same(got.filter("page_id = 8").select("page_id", "path", "digest"), con, f"SELECT * FROM ({sql}) WHERE page_id = 8")
    same(got.select("page_id", "digest"), con, f"SELECT page_id, digest FROM ({sql})")


def test_documents_read_back_are_not_broadcast(spark, sf_dir):
    from palimpsest import registry

    got = registry.queries()["wiki_archive"](spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
