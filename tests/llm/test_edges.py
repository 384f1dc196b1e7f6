"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import byte_bpe, decontaminate, line_dedup, lm_score, quality_cnn, quality_rules, simhash, substring_dedup, token_blocks, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, __row string, n_lines string"
LONG = " ".join(f"word{i}" for i in range(3000)) + "\n" + "x" * 30000
ROWS = [
    (1, None, "en", None, None, 1, "a", "b"), (2, "", "en", "s", 0, 1, "a", "b"), (3, " \n\t", None, "s", 3, None, None, None), (4, "A plain line of words, which ends here.\nSecond one.", "en", "s", 50, 1, "a", "b"),
    (4, "A plain line of words, which ends here.\nSecond one.", "en", "s", 50, 1, "a", "b"), (4, "another text with the same id", "en", "s", 29, 1, "a", "b"), (None, "no id at all but some words", "en", "s", 27, 1, "a", "b"),
    (None, None, None, None, None, None, None, None), (5, LONG, "en", "s", len(LONG), 1, "a", "b"), (6, "é😀 ß \x00 \x1c end", "fr", "s", 12, 1, "a", "b"),
]
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_lm_score(spark, docs, none):
    got = lm_score.score_all(docs).collect()
    assert len(got) == len(ROWS) and sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    by_size = {(r.doc_id, r.n_tokens) for r in got}
    assert {(1, 1), (2, 1), (3, 1), (None, 1)} <= by_size
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert lm_score.score_all(none).count() == 0
    # nothing to learn from: all documents held out
    out = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens, r.base_score) for r in lm_score.score_all(out).collect()} == {(0, 0, 0.0)}


def test_simhash(docs, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    zero = {r for r in got if r[1] == "0" * 16}
    assert {r[0] for r in zero} == {1, 2, 3, None} and {r[2] for r in zero} == {1}
    assert simhash.near_duplicates(docs).count() == len(ROWS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 4, 5, 6]
    # the null texts' component has a doc_id, the other row without id stands alone
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["no id at all but some words"]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_quality_rules(docs, none):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(ROWS)
    assert {(r.n_words, r.kept) for r in got if r.doc_id in (1, 2, 3)} == {(0, False)}
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.clean(docs).columns == docs.columns


def test_warc(spark, docs, none):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a b/\r\nX: y").alias("url"), F.col("text").alias("html"), F.lit(1).alias("first"))
    got = warc.round_trip(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(d), len(b := (t or "").encode()), hashlib.sha256(b).hexdigest()) for d, t, *_ in ROWS)
    assert {r.url for r in got} == {"http://a%20b/%0D%0AX:%20y"}
    assert warc.round_trip(none.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).count() == 0


def test_quality_cnn(spark, docs, none):
    for rows in ([], [(4, 1, 0)], [(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0)]):
        got = quality_cnn.score(docs, quality_cnn.fit(docs, labels(spark, rows))).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    net = quality_cnn.fit(none, labels(spark, []))
    assert quality_cnn.score(none, net).count() == 0
    assert quality_cnn.keep_good(docs, net).columns == docs.columns


def test_byte_bpe(docs, none):
    got = byte_bpe.digests(docs, RANKS, PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    back = byte_bpe.encode(docs, RANKS, PATTERN, "fp").select("text", "fp").collect()
    assert all(byte_bpe.decode(r.fp, RANKS, PATTERN) == (r.text or "").encode() for r in back)
    assert byte_bpe.digests(none, RANKS, PATTERN).count() == 0


def test_line_dedup(docs, none):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(ROWS) and all(r.n_dropped == 0 for r in got)
    assert {r.n_lines for r in got if r.doc_id in (1, 2)} == {1}
    # the text four documents and one without id hold is not common enough
    assert line_dedup.dedup_lines(docs, min_chars=5, min_docs=2).count() == len(ROWS)
    assert line_dedup.dedup_lines(none).count() == 0


def test_substring_dedup(docs, none):
    assert substring_dedup.spans(none).count() == 0
    assert substring_dedup.spans(docs).filter("doc_id <= 4").count() == 0
    got = substring_dedup.clean(docs)
    assert got.count() == len(ROWS) and "removed_spans" in got.columns


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "Second one"), (2, None), (3, ""), (None, "plain line"), (1, "second ONE")], "item_id long, text string")
    got = decontaminate.search(docs, decontaminate.prepare(items)).collect()
    assert len(got) == len(ROWS)
    hit = [r for r in got if r.n_hit]
    assert {(r.doc_id, r.n_hit, tuple(r.item_ids), r.contaminated) for r in hit} == {(4, 2, (1,), True)} and len(hit) == 2
    assert decontaminate.remove_contaminated(docs, decontaminate.prepare(items)).count() == len(ROWS) - 2
    empty = decontaminate.prepare(items.limit(0))
    assert all(not r.contaminated for r in decontaminate.search(docs, empty).collect())
    assert decontaminate.search(none, empty).count() == 0


def test_token_blocks(docs, none):
    got = token_blocks.round_trip(docs, WORDS).collect()
    assert len(got) == len(ROWS)
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert token_blocks.round_trip(none, WORDS).count() == 0


def test_pipeline_stages(spark, docs, none, tmp_path):
    labels(spark, [(4, 1, 0), (5, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for at in (docs.select(plain), none.select(plain)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "encode":
                assert out.columns == plain
                at = spark.createDataFrame(out.collect(), at.schema)
            else:
                assert out.count() == at.count()
