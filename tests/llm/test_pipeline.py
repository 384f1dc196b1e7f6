"""The pipeline stage by stage against plain versions; ties and very long texts through all operators."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import byte_bpe, decontaminate, line_dedup, lm_score, quality_cnn, quality_rules, simhash, substring_dedup, token_blocks, warc

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def others():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def fingerprint(text):
    w = SPACED.findall((text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_score(p, text):
    """The classifier's score, window by window."""
    raw = (text or "").encode()
    padded = raw + bytes(quality_cnn.WIDTH + 1)
    n = max(1, len(raw))
    act = [sum(p["taps"][k][padded[i + k]].astype(float) for k in range(quality_cnn.WIDTH)) for i in range(n)]
    segments = [np.max(act[i : i + quality_cnn.SEGMENT], axis=0) for i in range(0, n, quality_cnn.SEGMENT)]
    step = quality_cnn.SEGMENTS - 1
    chunks = [np.max(segments[i : i + quality_cnn.SEGMENTS], axis=0) for i in range(0, max(1, len(segments) - 1), step)]
    pooled = np.maximum(np.array(chunks) + p["bias"], 0)
    z = np.concatenate([pooled.mean(0), pooled.max(0), [np.log1p(n) / 10]])
    hidden = np.maximum(z @ p["inner"] + p["inner_bias"], 0)
    return 1 / (1 + np.exp(-(hidden @ p["outer"] + p["prior"][0])))


def test_stages_against_plain_versions(spark, sf_dir, others):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    def step(name, at):
        out = stage[name](spark, at, sf_dir)
        assert name == "encode" or out.columns == docs.columns
        kept = out.collect()
        return spark.createDataFrame(kept, out.schema), kept

    net = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    at, kept = step("quality", docs)
    scores = {d: plain_score(net.p, t) for d, t in rows(docs).items()}
    got = {r.doc_id: r.score for r in quality_cnn.score(docs, net).collect()}
    assert all(abs(got[d] - s) < 1e-3 for d, s in scores.items())
    assert {r.doc_id for r in kept} == {d for d, s in got.items() if s >= 0.5}

    before = rows(at)
    at, kept = step("line_dedup", at)
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    for d, t in before.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(d)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 5}
    want = {d: None if t is None else "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in before.items()}
    assert {r.doc_id: r.text for r in kept} == want and all(r.n_chars == len(r.text) for r in kept if r.text != before[r.doc_id])

    before = rows(at)
    at, kept = step("near_dedup", at)
    fps, root = {d: fingerprint(t) for d, t in before.items()}, {d: d for d in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in kept} == {d for d in fps if find(d) == d}

    before = rows(at)
    at, kept = step("decontaminate", at)
    words = lambda t: CLEAN.findall((t or "").translate(LOWER))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(t):
        w, hit = words(t), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        return not (hit and 20 * len(hit) >= len(w))

    assert {r.doc_id for r in kept} == {d for d, t in before.items() if clean(t)}

    before = rows(at)
    _, kept = step("encode", at)
    ids = {d: others.encode_ordinary(t or "") for d, t in before.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in kept} == {d: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for d, x in ids.items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(ids)


LONG = " ".join(f"{'Word' if i % 7 else 'mot'}{i * 7919 % 60_000}{'.' if i % 9 == 0 else ''}" + ("\n" if i % 40 == 39 else "") for i in range(230_000))


def test_a_text_of_megabytes(spark, others):
    assert len(LONG) > 2_000_000
    small = [(i, f"A small text, number {i}, which stands beside the long one and says little.") for i in range(2, 8)]
    docs = spark.createDataFrame([(1, LONG), *small], "doc_id long, text string").coalesce(1)
    of = lambda df: next(r for r in df.collect() if r.doc_id == 1)
    words = SPACED.findall(LONG)
    r = of(lm_score.score_all(docs))
    assert r.n_tokens == len(words) + 1 and r.score < 0
    assert of(simhash.near_duplicates(docs)).fingerprint == f"{fingerprint(LONG):016x}"
    assert of(quality_rules.judge(docs)).n_words == len(words)
    r = next(r for r in warc.round_trip(docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))).collect() if r.page_id == 1)
    assert (r.payload_bytes, r.payload_digest) == (len(LONG.encode()), hashlib.sha256(LONG.encode()).hexdigest())
    net = quality_cnn.Network().compile()
    assert abs(of(quality_cnn.score(docs, net)).score - net.score([LONG])[0]) < 1e-6
    ids = others.encode_ordinary(LONG)
    r = of(byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN))
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LONG.encode()).hexdigest())
    r = of(line_dedup.dedup_lines(docs))
    assert (r.text, r.n_lines, r.n_dropped) == (LONG, LONG.count("\n") + 1, 0)
    assert substring_dedup.clean(docs).count() == 7
    item = " ".join(CLEAN.findall(LONG.translate(LOWER))[100_000:100_020])
    r = of(decontaminate.search(docs, decontaminate.prepare(spark.createDataFrame([(5, item)], "item_id long, text string"))))
    assert r.n_words == len(CLEAN.findall(LONG.translate(LOWER))) and r.item_ids == [5] and not r.contaminated
    want = np.array([*Tokenizer.from_file(WORDS).encode(LONG, add_special_tokens=False).ids, 2], "<u4")
    r = of(token_blocks.round_trip(docs, WORDS))
    assert (r.n_tokens, r.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))


def test_ties(spark):
    """Equal ids, texts, counts and hashes: each operator has one defined result."""
    line, other = "this line is one that many documents hold, and it is long", "another line which is long enough to be seen by all"
    rows = [(i, line) for i in range(4)] + [(9, line), (9, line), (9, other), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(kept, key=str) == sorted([*((i, "", 1) for i in range(4)), (9, line, 0), (9, line, 0), (9, other, 0), (None, line, 0)], key=str)
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert groups == {(0, 0), (1, 0), (2, 0), (3, 0), (9, 0), (None, 0), (9, 9)}
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(0, line), (9, other)]
    pages = spark.createDataFrame([(p, "u", "x" * 200) for p in (3, 3, 5, 5, None)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()) == [(0, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3), (5, "revisit", 3)]
    items = spark.createDataFrame([(1, line), (2, line.upper()), (1, line)], "item_id long, text string")
    twice = spark.createDataFrame([(7, f"{line} {line}")], "doc_id long, text string")
    (r,) = decontaminate.search(twice, decontaminate.prepare(items)).collect()
    assert (r.n_words, r.n_hit, sorted(r.item_ids)) == (2 * len(line.split()), 2 * len(line.split()), [1, 2])
    got = sorted((r.start, r.n_tokens) for r in token_blocks.round_trip(docs, WORDS).collect())
    assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))
    scores = defaultdict(set)
    for r in lm_score.score_all(docs).join(docs.distinct(), "doc_id").collect():
        scores[r.doc_id].add(round(r.score, 9))
    assert all(len(v) == 1 for d, v in scores.items() if d != 9)
    long = " ".join(f"w{i}" for i in range(80))
    same = spark.createDataFrame([(4, long), (4, long), (6, long)], "doc_id long, text string")
    assert {(r.doc_id, r.kept_doc_id, r.n_words) for r in substring_dedup.spans(same).collect()} == {(6, 4, 80)}
    assert len({r.score for r in quality_cnn.score(docs.filter(F.col("text") == line), quality_cnn.Network().compile()).collect()}) == 1
