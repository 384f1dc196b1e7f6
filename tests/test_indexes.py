"""Stored indexes against plain scans: recall, pruning, appended rows, positions, skipped blocks."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.stem import STOP, english
from palimpsest.operators import text_index, vector_index


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    at = r.normal(size=(20, 16))
    v = at[r.integers(20, size=1500)] + r.normal(size=(1500, 16)) * 0.3
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in enumerate(v)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, rows[0][1]), (5003, rows[0][1])]
    return rows, spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(5)


def plain(rows, questions, k):
    items = [(i, np.array(e, np.float64) / np.linalg.norm(e)) for i, e in rows if e is not None and any(e)]
    out = {}
    for q, e in questions:
        e = np.array(e, np.float64) / np.linalg.norm(e)
        out[q] = [i for _, i in sorted((round(1 - float(v @ e), 9), i) for i, v in items)[:k]]
    return out


def found(df):
    out: dict = {}
    for r in df.orderBy("question_id", "rank").collect():
        out.setdefault(r.question_id, []).append(r.item_id)
    return out


def test_vector_index_is_exact_or_nearly_so(spark, clustered, tmp_path):
    rows, df = clustered
    index = vector_index.build(df, str(tmp_path / "v"))
    questions = [(r[0], r[1]) for r in rows[::10] if r[1] is not None]
    asked = spark.createDataFrame([*questions, (-1, None), (-2, [0.0] * 16)], "question_id long, qvec array<float>")
    want = plain(rows, questions, 10)
    assert found(vector_index.search(index, asked, 10, exact=True)) == want
    got = found(vector_index.search(vector_index.load(spark, index.path), asked, 10))
    # an index that probes a part of its cells
    assert index.probes < len(index.centers) / 2
    assert min(len(set(got[q]) & set(want[q])) for q in want) >= 9
    assert vector_index.search(index, asked, 10, gate=0.05).filter("distance > 0.05").count() == 0


def test_vector_index_reads_only_probed_cells(spark, clustered, tmp_path):
    _, df = clustered
    index = vector_index.build(df, str(tmp_path / "v"))
    some = index.vectors([0, 1])
    assert "PartitionFilters: [isnotnull(cell" in (plan := some._jdf.queryExecution().toString()) or "PartitionFilters: [cell" in plan
    assert {f.split("cell=")[1].split("/")[0] for f in some.inputFiles()} >= {"0", "1"}
    total = sum(r.n for r in spark.read.parquet(f"{index.path}/reach").collect())
    assert total == index.vectors().count() == 1502
    assert index.vectors([0, 1]).count() < total / 4


def test_vectors_that_are_appended_are_found(spark, clustered, tmp_path):
    rows, df = clustered
    index = vector_index.build(df.filter("item_id % 3 <> 0"), str(tmp_path / "v"))
    late = df.filter("item_id % 3 = 0")
    vector_index.append(index, late)
    # a vector that lies like none before widens its cell
    vector_index.append(index, spark.createDataFrame([(9000, [-9.0] * 16)], "item_id long, embedding array<float>"))
    questions = [(r[0], r[1]) for r in rows[:300:30] if r[1] is not None] + [(9000, [-9.0] * 16)]
    asked = spark.createDataFrame(questions, "question_id long, qvec array<float>")
    assert found(vector_index.search(vector_index.load(spark, index.path), asked, 5, exact=True)) == plain([*rows, (9000, [-9.0] * 16)], questions, 5)


def test_vector_index_of_many_questions_and_of_none(spark, clustered, tmp_path, monkeypatch):
    rows, df = clustered
    monkeypatch.setattr(vector_index, "BLOCK", 20)
    index = vector_index.build(df, str(tmp_path / "v"))
    questions = [(r[0], r[1]) for r in rows[:120]]
    asked = spark.createDataFrame(questions, "question_id long, qvec array<float>")
    assert found(vector_index.search(index, asked, 3, exact=True)) == plain(rows, questions, 3)
    empty = vector_index.build(df.limit(0), str(tmp_path / "none"))
    assert vector_index.search(empty, asked, 3).count() == 0
    with pytest.raises(Exception, match="components are asked for"):
        vector_index.search(index, spark.createDataFrame([(1, [1.0])], "question_id long, qvec array<float>"), 3).count()


WORDS = "the running foxes jump over lazy dogs while generously feeding cats and dogs run by".split()


@pytest.fixture(scope="module")
def texts(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(600):
        n = int(r.integers(1, 60))
        own = [WORDS[j] if r.random() < 0.5 else f"w{r.integers(300)}" for j in r.integers(len(WORDS), size=n)]
        rows.append((i * 7, " ".join(own).title() if i % 2 else ", ".join(own)))
    rows += [(5, None), (6, ""), (8, " ".join(["dogs"] * 900 + ["cats"] * 300)), (9, "dogs " + "x " * 150 + "cats")]
    return rows, spark.createDataFrame(rows, "item_id long, text string").repartition(4)


def plain_search(rows, terms, config, score, k=10):
    lex = lambda w: w if config == "simple" else None if w in STOP else english(w)
    split = lambda s: [w for w in re.split(r"[\W_]+", s.lower()) if w]
    asked = {x for w in split(terms) if (x := lex(w))}
    out = []
    for i, text in rows:
        places: dict = {}
        ws = split(text or "")
        for p, w in enumerate(ws):
            if lex(w):
                places.setdefault(lex(w), []).append(p)
        if not asked or not asked <= set(places):
            continue
        if score == "frequency":
            s = sum((1 + math.log(len(places[t]))) / (1 + math.log(len(ws))) for t in asked)
        elif len(asked) == 1:
            s = 0.1 * sum(1 / (j + 1) ** 2 for j in range(len(places[min(asked)]))) / 1.64493406685
        else:
            s, order = 0.0, sorted(asked)
            for x, a in enumerate(order):
                for b in order[:x]:
                    for p in places[a]:
                        for q in places[b]:
                            d = abs(p - q)
                            if 0 < d <= 100:
                                s = 1 - (1 - s) * (1 - math.sqrt(0.1 * 0.1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
        out.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


QUESTIONS = [(1, "dogs cats"), (2, "running"), (3, "THE foxes, feeding"), (4, "generous run"), (5, "nowhere dogs"), (6, ""), (7, None), (8, "w17"), (9, "dogs dogs cats jump"), (10, "the by")]


@pytest.mark.parametrize("config", ["simple", "english"])
@pytest.mark.parametrize("score", ["proximity", "frequency"])
def test_text_index(spark, texts, tmp_path, config, score):
    rows, df = texts
    index = text_index.build(df, str(tmp_path / "t"), config, zone=16)
    asked = spark.createDataFrame(QUESTIONS, "question_id long, terms string")
    got: dict = {}
    for r in text_index.search(text_index.load(spark, index.path), asked, 10, score).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.item_id, r.score))
    for q, terms in QUESTIONS:
        want = plain_search(rows, terms or "", config, score)
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want], (q, got.get(q), want)
        assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in want], atol=2e-9)


def test_text_index_reads_only_the_terms_folders_and_skips_zones(spark, texts, tmp_path, monkeypatch):
    rows, df = texts
    index = text_index.build(df, str(tmp_path / "t"), zone=8)
    buckets = {r.bucket for r in index.blocks().filter(F.col("bucket") == text_index.bucket(F.lit("dogs"))).select("bucket").distinct().collect()}
    assert len(buckets) == 1
    # no block has more texts than it may, and all places are there
    assert index.blocks().filter(F.size("ids") > text_index.BLOCK).count() == 0
    places = index.blocks().select(F.explode("places").alias("x")).agg(F.sum(F.size("x"))).first()[0]
    assert places == sum(len([w for w in re.split(r"[\W_]+", (t or "").lower()) if w]) for _, t in rows)
    seen = []
    real = text_index._scored
    monkeypatch.setattr(text_index, "_scored", lambda own, asked, need, zones, score: (seen.append(zones.count()), real(own, asked, need, zones, score))[1])
    asked = spark.createDataFrame([(1, "dogs")], "question_id long, terms string")
    assert [r.item_id for r in text_index.search(index, asked, 1).collect()] == [8]
    every = index.blocks().filter("term = 'dogs'").select("zone").distinct().count()
    assert sum(seen) < every / 2


def test_a_search_keeps_the_best_of_a_zone_only(spark, texts, tmp_path, monkeypatch):
    """Words that nearly all texts have, asked for by many: hits don't leave the tasks that read the zones."""
    _, df = texts
    index = text_index.build(df, str(tmp_path / "t"), zone=64)
    seen, real = [], text_index._scored
    monkeypatch.setattr(text_index, "_scored", lambda own, asked, need, zones, score: (seen.append((zones.count(), (r := real(own, asked, need, zones, score)).count())), r)[1])
    asked = spark.createDataFrame([(i, "dogs") for i in range(20)], "question_id long, terms string")
    assert text_index.search(index, asked, 2).count() == 40
    assert all(rows <= 2 * zones for zones, rows in seen) and sum(rows for _, rows in seen) > 20


@pytest.mark.parametrize("score", ["proximity", "frequency"])
def test_full_zones_are_dealt(spark, texts, tmp_path, monkeypatch, score):
    rows, df = texts
    index = text_index.build(df, str(tmp_path / "t"), zone=1000)
    for name, value in {"FULL": 7, "FILTERED": 1, "RATED": 50, "ASKED": 3}.items():
        monkeypatch.setattr(text_index, name, value)
    asked = spark.createDataFrame(QUESTIONS[:4], "question_id long, terms string")
    got = text_index.search(index, asked, 10, score).orderBy("question_id", "rank").collect()
    for q, terms in QUESTIONS[:4]:
        assert [r.item_id for r in got if r.question_id == q] == [i for i, _ in plain_search(rows, terms or "", "simple", score)]


def test_texts_of_a_batch_are_rated_as_each_alone():
    import pyarrow as pa

    r = np.random.default_rng(4)
    rows = [[sorted(r.choice(400, int(r.integers(1, 60)), replace=False).tolist()) for _ in range(int(r.integers(1, 5)))] for _ in range(200)]
    got = text_index.proximities(pa.array(rows, pa.list_(pa.list_(pa.int32()))).slice(3))
    assert np.allclose(got, [text_index.proximity(x) for x in rows[3:]], atol=1e-12)


def test_a_text_is_posted_once(spark, texts, tmp_path, monkeypatch):
    """The posting isn't run again for the borders of ranges."""
    rows, df = texts
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    text_index.build(df.mapInArrow(counted, df.schema), str(tmp_path / "t"))
    # once to count the texts, once to post them
    assert seen.value == 2 * len(rows)


def test_every_hundredth_document_asks_the_english_index(spark, sf_dir):
    from palimpsest import registry

    got = registry.queries()["fts_index_english"](spark, sf_dir).select("question_id").distinct()
    assert {r.question_id for r in got.collect()} == {0, 100}


def test_recall_holds_for_every_question(spark, sf_dir, monkeypatch):
    """Also for questions that need more cells than the trials did."""
    from palimpsest import registry

    monkeypatch.setattr(vector_index, "_calibrated", lambda *_: 1)
    got = registry.queries()["vector_index_recall"](spark, sf_dir).collect()
    assert got and all(r.enough and r.nearest == 10 for r in got)
