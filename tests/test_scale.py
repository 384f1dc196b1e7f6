"""What must not grow with the tables: what is shuffled again for every channel."""

from palimpsest.plans import search as plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_channels_shuffle_no_texts(spark, sf_dir):
    """Chunks come from the scan as they are, and what channels look up of them is written once, without texts."""
    c = plans.search.placed(plans.corpus(spark, sf_dir))
    assert "Exchange" not in plan(c.chunks.select("item_id", "text"))
    assert {"text", "embedding"}.isdisjoint(c.places.columns)
    assert plans.search.placed(c) is c
    assert c.places.count() == c.chunks.count()
    # edges are read from what was written, not joined again
    assert "Join" not in plan(c.edges)


def test_many_keys_share_a_shard(spark, tmp_path, monkeypatch):
    """Keys that are walked together get the verdicts that each has alone."""
    from palimpsest.streaming import jobs, ordered

    from test_streams import got, made, plain, write

    monkeypatch.setattr(ordered, "SHARDS", 2)
    rows = made()
    for part in range(3):
        write(spark, rows[part::3], f"{tmp_path}/in")
    s = jobs.stream(spark, f"{tmp_path}/in", 1)
    assert got(ordered.judged(s, ordered.Grace(5), "4 days", f"{tmp_path}/out")) == plain(rows, ordered.Grace(5))


def test_dates_are_looked_for_once_a_row(spark, sf_dir):
    from palimpsest.plans.dating import date_math

    assert plan(date_math(spark, sf_dir)).count("regexp_extract_all(") == 3


def test_open_lines_are_grouped_before_they_meet_moments(spark, sf_dir):
    from palimpsest.plans.graph import as_of_join

    assert "l_orderkey" not in plan(as_of_join(spark, sf_dir))


def test_a_worker_has_few_texts_at_a_time(spark, sf_dir):
    from palimpsest.plans.ingest import chunk_lateral

    assert "ArrowEvalPythonUDTF" not in plan(chunk_lateral(spark, sf_dir))


def test_texts_are_stemmed_in_bounded_batches(spark):
    from palimpsest.functions.stem import stemmed_texts

    df = spark.createDataFrame([(1, "Running dogs ran"), (2, None), (3, ""), (4, "the of"), (5, "dog")], "id long, text string").coalesce(1)
    out = stemmed_texts(df)
    assert "MapInArrow" in plan(out) and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert {r.id: r.text for r in out.collect()} == {1: "run dog ran", 2: None, 3: "", 4: "the of", 5: "dog"}


def test_joins_of_edges_have_tasks_of_bounded_size(spark, sf_dir, duck, monkeypatch):
    """Tables with more rows than cores hold at once are met in more tasks, not in larger ones, with the same rows."""
    from palimpsest import registry
    from palimpsest.operators import joins, retrieval
    from palimpsest.plans.graph import _open_lines
    from palimpsest.sources.tables import edges

    from conftest import same

    monkeypatch.setattr(joins, "TASK", 600)
    monkeypatch.setattr(joins, "MOST", 50)
    monkeypatch.setattr(joins, "TOLD", 1)
    monkeypatch.setattr(retrieval, "small", lambda df: joins.small(df, 50))
    for df in (edges(spark, sf_dir).filter("kind = 'uses'"), _open_lines(spark, sf_dir)):
        assert max(len(p) for p in df.rdd.glom().collect()) < 1000
    for name in ("entity_pages_as_of", "telemetry_coverage", "graph_connectors"):
        same(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


def test_a_key_of_many_rows_is_dealt_to_several_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from palimpsest.operators import joins

    monkeypatch.setattr(joins, "TASK", 100)
    monkeypatch.setattr(joins, "TOLD", 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # half of all rows have one key, some have none
    big = spark.range(4000).select(F.when(F.col("id") % 50 == 49, None).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    few = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w")).unionByName(spark.range(2).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("w")))
    for how in ("inner", "left"):
        got = joins.meet(big, few, "k", 4000, how)
        assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, big.join(few, "k", how).select("k", "v", "w").collect()))
    assert max(len(p) for p in joins.meet(big, few, "k", 4000).rdd.glom().collect()) < 1500  # of 6,000 with the key
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
