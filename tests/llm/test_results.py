"""Operators against brute force, other libraries, round trips and held-out labels."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from palimpsest.llm import byte_bpe, decontaminate, line_dedup, lm_score, oracles, quality_cnn, queries, simhash, substring_dedup, token_blocks, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, sf_dir, duck, name):
    same(queries.queries()[name](spark, sf_dir), duck, oracles.SQL[name])


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= {k.split("_")[0] for k in __spark_entry__.queries()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]


def test_lm_base_and_gain(spark, sf_dir, texts):
    got = queries.op1_lm_score(spark, sf_dir).collect()
    tok = {d: SPACED.findall((t or "").translate(LOWER)) + [""] for d, t in texts.items()}
    held = {d for d in tok if zlib.crc32(str(d).encode()) % 7 == 2}
    c = Counter(w for d, own in tok.items() if d not in held for w in own)
    n, v = sum(c.values()), len(c)
    for r in got:
        own = tok[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(own), sum(w in c for w in own), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-6 * abs(r.base_score)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def _fitted(docs):
    counts, v, flat = lm_score.fit(docs.filter(~lm_score.held_out()))
    return counts, v, lm_score.LogBilinear(v.share, v.within).load(flat)


def test_lm_score_is_the_models_probability(spark, sf_dir, texts):
    """Every token's log-probability by plain sums over the fitted vectors, and a distribution over all words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, v, m = _fitted(docs)
    c = {bytes(r.word): r.c for r in counts.collect()}
    head = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    own = [b"", *[w for w, _ in head if w][: lm_score.OWN - 1]]
    rank, p = {w: i for i, w in enumerate(own)}, {k: x.astype(float) for k, x in m.p.items()}
    left = Counter()
    for w, n in c.items():
        if w not in rank:
            left[w[-2:]] += n
    endings = [e for e, _ in sorted(left.items(), key=lambda x: (-x[1], x[0]))][: lm_score.TAILS - 1]
    tail = lambda w: endings.index(w[-2:]) + 1 if w[-2:] in endings else 0
    n_of, v_of = Counter(), Counter()
    for w, n in c.items():
        if w not in rank:
            n_of[tail(w)] += n
            v_of[tail(w)] += 1
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def probability(before, w):
        q = sum(p["context"][u] * p["position"][k] for k, u in enumerate(before))
        first = soft(p["class"] @ q + p["class_bias"])
        if w in rank:
            k, i = divmod(rank[w], lm_score.PER_CLASS)
            of = slice(k * lm_score.PER_CLASS, (k + 1) * lm_score.PER_CLASS)
            return first[k] * soft(p["word"][of] @ q + p["word_bias"][of])[i]
        return first[lm_score.CLASSES + tail(w)] * (c.get(w, 0) + 1) / (n_of[tail(w)] + v_of[tail(w)] + 1)

    got = {r.doc_id: r.score for r in lm_score.score(docs, counts, v, m.flat()).collect()}
    for d in sorted(texts)[:25]:
        words = [w.encode() for w in SPACED.findall((texts[d] or "").translate(LOWER))] + [b""]
        units = [rank[w] if w in rank else lm_score.OWN + tail(w) for w in words]
        want = sum(np.log10(probability([units[i - k] if i >= k else 0 for k in range(1, lm_score.CONTEXT + 1)], w)) for i, w in enumerate(words))
        assert abs(got[d] - want) < 1e-4 * abs(want)
    for before in ([0, 0, 0, 0], [5, 1, 0, 0], [lm_score.OWN + 3, 40, 2, 7]):
        # an unseen word takes the share that its class leaves for all of them
        seen = sum(probability(before, w) for w in rank) + sum(probability(before, w) for w in c if w not in rank)
        spare = sum(soft(p["class"] @ sum(p["context"][u] * p["position"][k] for k, u in enumerate(before)) + p["class_bias"])[lm_score.CLASSES + t] / (n_of[t] + v_of[t] + 1) for t in range(lm_score.TAILS))
        empty = len(own) < lm_score.OWN  # places for own words that the corpus doesn't have
        assert seen + spare < 1 + 1e-4 and (empty or seen + spare > 1 - 1e-4)


def test_lm_does_not_depend_on_the_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, many = (_fitted(d)[2].flat() for d in (docs.coalesce(1), docs.repartition(13)))
    assert np.allclose(one, many, atol=1e-5)


def test_the_head_is_full_when_all_counts_are_equal(spark):
    counts = spark.createDataFrame([(b"w%d" % i, 3) for i in range(2000)] + [(b"x", 90)], "word binary, c long")
    got = lm_score.commonest(counts, 500)
    assert got[0] == (b"x", 90) and 400 < len(got) < 600 and len(lm_score.commonest(counts, 5000)) == 2001


def test_fingerprints_and_components(spark, sf_dir, texts):
    got = queries.op2_simhash(spark, sf_dir).collect()

    def fp(t):
        w = SPACED.findall(t.translate(LOWER))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = {d: fp(t) for d, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{x:016x}" for d, x in fps.items()}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: r.component_id for r in got} == {d: find(d) for d in ids}


def test_ball_hashing_finds_every_link():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for x in base:
        for k in (1, 2, 3, 4, 6):
            for _ in range(3):
                y = x
                for b in rng.sample(range(64), k):
                    y ^= 1 << b
                fps.add(y)
    fps = sorted(fps)
    rows = list(simhash._emit(3)([np.array(fps, np.uint64).view(np.int64)]))
    where = defaultdict(list)
    for out in rows:
        for bucket, f, n, c in zip(*out, strict=True):
            where[bucket].append((np.repeat(np.frombuffer(f, np.uint64), np.frombuffer(n, np.uint16)), np.frombuffer(c, np.uint16)))
    links = set()
    for parts in where.values():
        a, b = simhash.meet(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        links |= {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)}
    assert all((a ^ b).bit_count() <= 3 for a, b in links)

    def classes(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = defaultdict(set)
        for x in fps:
            groups[find(x)].add(x)
        return {frozenset(g) for g in groups.values()}

    assert classes(links) == classes((a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3)


def test_damaged_archives_are_noticed():
    whole = warc.record(1, "http://a", b"hello" * 50) + warc.record(2, None, b"", None)
    assert [warc.page(*r)[0] for r in warc.read_records(io.BytesIO(whole))] == [1, 2]
    first = warc.record(1, None, b"x" * 200)
    for damaged in (whole[:-5], first[:40] + bytes([first[40] ^ 255]) + first[41:], b"no gzip"):
        with pytest.raises(warc.DamagedRecord):
            list(warc.read_records(io.BytesIO(damaged)))


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_cnn(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93
    bad, good = ([r.score for r in got if r.quality == v] for v in (0, 1))
    assert np.mean([a < b for a in bad for b in good]) > 0.95


def test_a_long_text_costs_no_other_its_place(spark):
    docs = spark.createDataFrame([(i, f"bad {i} " * 9 if i % 2 else f"good {i} " * 9) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    sample = lambda d, **k: (quality_cnn.fit(d, labels, **k), seen.pop())[1]
    learn, quality_cnn.train = quality_cnn.train, lambda texts, y: (seen.append((texts, y)), quality_cnn.Network().compile())[1]
    try:
        every = sample(docs)
        # each id in turn is the long one, and so the first by hash too
        for long in range(0, 60, 7):
            got = sample(docs.withColumn("text", F.when(F.col("doc_id") == long, F.repeat("text", 2000)).otherwise(F.col("text"))), max_bytes=20_000)
            own = f" {long} "
            assert got[0] == [t for t in every[0] if own not in t]
        # of 2 ids a label only one fits, of those that were drawn none
        ids = [i for _, i in sorted((r.h, r.doc_id) for r in docs.filter(~quality_cnn.held_out()).select(F.xxhash64("doc_id").alias("h"), "doc_id").collect()) if i % 2]
        got = sample(docs.withColumn("text", F.when(F.col("doc_id").isin(ids[:-1]), F.repeat("text", 200)).otherwise(F.col("text"))), max_docs=4, max_bytes=4000)
        assert [t for t, y in zip(*got, strict=True) if y == 0] == [f"bad {ids[-1]} " * 9] and sum(got[1]) == 2
        bad_long = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.repeat("text", 200)).otherwise(F.col("text")))
        assert set(sample(bad_long, max_bytes=4000)[1]) == {1}
    finally:
        quality_cnn.train = learn
    # of label 0 no text fits: all scores are the share of label 1
    known = [r.quality for r in labels.filter(~quality_cnn.held_out()).distinct().collect()]
    scores = {round(r.score, 5) for r in quality_cnn.score(bad_long, quality_cnn.fit(bad_long, labels, max_bytes=4000)).collect()}
    assert scores == {round(sum(known) / len(known), 5)}


def test_pooling_covers_every_byte():
    net = quality_cnn.Network()
    x = quality_cnn.Texts(["", None, "abc", "x" * 64, "y" * 65, "hello world " * 100, "é" * 700])
    slow = net.pooled(x)
    assert np.allclose(slow, net.compile().pooled(x), atol=1e-4)
    for i, (a, b) in enumerate(zip(x.seg_start, x.seg_stop, strict=True)):
        assert np.allclose(slow[i], np.max([sum(net.p["taps"][k][x.bytes[p + k]] for k in range(quality_cnn.WIDTH)) for p in range(a, b)], axis=0), atol=1e-4)


def odd_texts():
    rng = random.Random(1)
    some = [chr(c) for c in range(0x300)] + list("  \n\n\t\r    'sst'reve'll '' 12 ²½一二あé́😀 　\x1c\x85\xa0Ⅷ٣_İßΣςΑÁ") * 8
    out = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    out += ["".join(rng.choice("aBéÀ 'st \n\t.1_") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    return [*out, "a" * 5000, " " * 3000, "ab" * 700 + "\n\n  \n x", "é" * 600, "x" * 257, "<|endoftext|>"]


@pytest.fixture(scope="module")
def others():
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_tiktokens(texts, others):
    bpe = byte_bpe.tokenizer(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(3)
    every = odd_texts() + list(texts.values())
    every += ["".join(rng.choice(x) for _ in range(n)) for x in ("ACGT", "abcdefghijklmnop", "01", "一二三四", "eatonhr") for n in (250, 256, 257, 300, 5000)]
    for t, raw in zip(every, bpe.encode(every), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == others.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()
        assert bpe.written(ids) == ",".join(map(str, ids.tolist())).encode()


def test_byte_bpe_with_any_ranks():
    """Merges that rank below their parts, which no trained vocabulary has: rows of any length merge one pair a round."""
    rng = random.Random(2)
    for _ in range(40):
        ranks = {bytes([c]): i for i, c in enumerate(range(256))}
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(30)}
        ranks |= {w: 256 + i for i, w in enumerate(rng.sample(sorted(words), len(words)))}
        bpe = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
        pieces = ["".join(rng.choice("abc") for _ in range(n)).encode() for n in (7, 30, 255, 257, 400)]
        for piece, raw in zip(pieces, bpe.merge(pieces), strict=True):
            ids = [bytes([c]) for c in piece]
            while len(ids) > 1 and (best := min((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))))[0] < 10**9:
                ids[best[1] : best[1] + 2] = [ids[best[1]] + ids[best[1] + 1]]
            assert np.frombuffer(raw, "<u4").tolist() == [ranks[x] for x in ids]


def test_byte_bpe_query(spark, sf_dir, texts, others):
    want = {}
    for d, t in texts.items():
        ids = others.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_byte_bpe(spark, sf_dir).collect()} == want


def test_word_ids_are_the_librarys(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    every = odd_texts() + list(texts.values())[:60]
    for t, ids in zip(every, token_blocks.tokenizer(path).encode(every), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(t, add_special_tokens=False).ids


def test_blocks_round_trip(tmp_path):
    rng = np.random.default_rng(0)
    for n in (1, 127, 128, 129, 1000, 50_000):
        x = rng.integers(0, 49_408, n).astype("u4")
        x[rng.random(n) < 0.03] = 2**32 - 1
        assert (token_blocks.unpack(token_blocks.pack(x)) == x).all()
    w = token_blocks.Writer(str(tmp_path / "a.pfor"))
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 3_000_000, 1, 77)]
    for i, d in enumerate(docs):
        w.add(i or None, d.tobytes())
    assert w.close() == sum(map(len, docs))
    r = token_blocks.Reader(str(tmp_path / "a.pfor"))
    assert [(a, len(c), (c == d).all()) for (a, _, c), d in zip(r.documents(), docs, strict=True)] == [(i or None, len(d), True) for i, d in enumerate(docs)]
    flat = np.concatenate(docs)
    for a, b in ((0, 1), (5, 200), (1_048_570, 1_048_580), (2_999_000, 3_000_083)):
        assert (r.slice(a, b) == flat[a:b]).all()


def test_blocks_query(spark, sf_dir, texts):
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for d in sorted(texts):
        ids = np.array(other.encode(texts[d], add_special_tokens=False).ids + [2], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_token_blocks(spark, sf_dir).collect()} == want


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(-(2**63), 2**63 - 1, (2, 6000))
    f = line_dedup.CuckooFilter(3000)
    f.insert(h1[:3000], h2[:3000])
    assert f.contains(h1[:3000], h2[:3000]).all() and f.contains(h1[3000:], h2[3000:]).mean() < 0.01
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    f.delete(h1[:1500], h2[:1500])
    assert f.contains(h1[1500:3000], h2[1500:3000]).all() and f.contains(h1[:1500], h2[:1500]).mean() < 0.01


def test_deleting_documents_undoes_inserting_them(spark):
    line = "this line has more than forty code points in it"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(4)], "doc_id long, text string")
    more = spark.createDataFrame([(9, line.upper() + "  "), (10, line)], "doc_id long, text string")
    index = line_dedup.build(docs)
    assert line_dedup.drops(index).count() == 0
    grown = line_dedup.insert(index, more)
    assert {r.doc_id for r in line_dedup.drops(grown).collect()} == {0, 1, 2, 3, 9}
    back = line_dedup.delete(grown, more)
    assert line_dedup.drops(back).count() == 0
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, index.refs.collect()))


def test_repeated_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)) for _ in range(n)) + "."
    dotted, plain = prose(6), " ".join(word() for _ in range(60))
    rows = [(1, prose(3) + " and so " + dotted + " then " + prose(2)), (2, prose(2) + "\nhere " + dotted + "\n" + prose(2)), (3, prose(5)), (4, prose(2) + " x " + plain + " y. " + prose(2)), (5, "z " + plain + " w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.spans(docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(2, 1), (5, 4)}
    texts = dict(rows)
    for r in got:
        assert r.n_words >= 20 and texts[r.doc_id][r.start : r.stop].strip() in texts[r.kept_doc_id]
    clean = {r.doc_id: r for r in substring_dedup.clean(docs).collect()}
    assert clean[3].text == texts[3] and clean[1].text == texts[1] and len(clean[2].text) < len(texts[2]) - 200
    s = clean[2].removed_spans[0]
    assert clean[2].text == texts[2][: s.start] + texts[2][s.stop :]


def _places(text):
    """(normalised words, their offsets, word ranges of lines) of a text, by plain means."""
    found = [(m.group().translate(LOWER), m.start(), m.end()) for m in SPACED.finditer(text or "")]
    lines, at = [], 0
    for x in (text or "").split("\n"):
        n = len(SPACED.findall(x))
        lines.append((at, at + n))
        at += n
    return [f[0] for f in found], [f[1:] for f in found], lines


def test_repeated_lines_and_passages_by_brute_force(spark, sf_dir, texts):
    """What goes stands earlier, whole; lines that stand earlier go from end to end; long passages leave at most their ends."""
    got = defaultdict(list)
    for r in queries.op8_substring_dedup(spark, sf_dir).collect():
        got[r.doc_id].append(r)
    lines, windows, n_lines, n_long = {}, {}, 0, 0
    for d in sorted(texts):
        w, at, own = _places(texts[d])
        start_of, stop_of = {x[0]: i for i, x in enumerate(at)}, {x[1]: i + 1 for i, x in enumerate(at)}
        gone = set()
        for r in got.get(d, []):
            a, z = start_of[r.start], stop_of[r.stop]
            assert r.n_words == z - a >= 16
            gone |= set(range(a, z))
        # earlier in this text or in a smaller doc_id, or an earlier place of this one
        seen_line = {" ".join(w[x:y]) for x, y in own if y - x >= 16}
        twice = Counter(" ".join(w[x:y]) for x, y in own if y - x >= 16)
        own_windows = Counter(" ".join(w[i : i + 25]) for i in range(len(w) - 24))
        covered = set()
        for x, y in own:
            if y - x >= 16 and (" ".join(w[x:y]) in lines or twice[" ".join(w[x:y])] > 1):
                covered |= set(range(x, y))
        for i in range(len(w) - 24):
            key = " ".join(w[i : i + 25])
            if key in windows or own_windows[key] > 1 or key in lines:
                covered |= set(range(i, i + 25))
        for x, y in own:  # a line of 25 words may equal a window of an earlier text
            if y - x == 25 and " ".join(w[x:y]) in windows:
                covered |= set(range(x, y))
        assert gone <= covered
        for x, y in own:
            if y - x >= 16 and " ".join(w[x:y]) in lines:
                assert set(range(x, y)) <= gone
                n_lines += 1
        # of 41 words in a row whose windows all stand earlier, some go
        run = 0
        for i in range(len(w) - 24):
            run = run + 1 if " ".join(w[i : i + 25]) in windows else 0
            if run >= 17:
                assert gone & set(range(i - 16, i + 25))
                n_long += 1
        lines.update(dict.fromkeys(seen_line, d))
        windows.update(dict.fromkeys(own_windows, d))
    assert n_lines > 50 and n_long > 50


def test_a_repeated_line_goes_whole_and_the_earliest_stays(spark):
    line = " ".join(f"Word{i}" for i in range(16))
    short = " ".join(f"few{i}" for i in range(15))
    rows = [(3, f"before\n  {line.upper()}  \nafter\n{short}"), (1, f"{short}\n{line}\n{short}"), (2, f"x {line}\n{line}"), (None, line)]
    got = {(r.doc_id, r.start, r.stop, r.n_words, r.kept_doc_id) for r in substring_dedup.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    at = lambda d, x: (text[d].index(x), text[d].index(x) + len(x))
    second = len(f"x {line}\n")
    assert got == {(3, *at(3, line.upper()), 16, 1), (2, second, second + len(line), 16, 1), (None, 0, len(line), 16, 1)}


def test_a_row_that_repeats_very_often_counts_once(spark):
    """Thousands of copies of a row: no array holds them, and each loses the same spans."""
    text = " ".join(f"w{i}" for i in range(400))
    copies = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = copies.unionByName(spark.createDataFrame([(1, text), (None, text), (None, text)], "doc_id long, text string")).repartition(6)
    assert {(r.doc_id, r.start, r.stop, r.n_words, r.kept_doc_id) for r in substring_dedup.spans(docs).collect()} == {(d, 0, len(text), 400, 1) for d in (7, None)}
    kept = substring_dedup.clean(docs).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text, r["count"]) for r in kept} == {(1, text, 1), (7, "", 3000), (None, "", 2)}


def test_passages_within_lines_are_found(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(300):
        passage = words(51)
        if i % 2:
            passage[9::10] = [x + "." for x in passage[9::10]]
        for d in (2 * i, 2 * i + 1):
            rows.append((d, " ".join([*words(rng.randrange(80)), *passage, *words(rng.randrange(80))])))
        want[2 * i + 1] = (2 * i, " ".join(passage))
    got = defaultdict(list)
    for r in substring_dedup.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    for d, own in got.items():
        kept, passage = want[d]
        for r in own:
            found = rows[d][1][r.start : r.stop]
            assert r.kept_doc_id == kept and found in passage and r.n_words == len(found.split()) >= 25


def test_overlapping_spans_go_once(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    cut = a[: a.index(" a40")] + " " + b[: b.index(" b30")]
    rows = [(1, a), (2, b), (3, cut), (4, "x " + a + " y " + b + " z"), (5, "q " * 90)]
    for r in substring_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text, spans = dict(rows)[r.doc_id], [(s.start, s.stop) for s in r.removed_spans]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert r.text == "".join(c for i, c in enumerate(text) if not any(x <= i < y for x, y in spans))
        assert not spans if r.doc_id < 3 else spans


def test_longest_matches(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = spark.createDataFrame([(1, "so " + item.upper() + " end"), (2, " ".join(item.split()[:13]) + " other"), (3, "alpha beta")], "doc_id long, text string")
    got = decontaminate.longest_matches(docs, decontaminate.prepare(spark.createDataFrame([(7, item)], "item_id long, text string")))
    assert {tuple(r) for r in got.collect()} == {(1, 1, 7, 0, 15), (1, 2, 7, 1, 14), (1, 3, 7, 2, 13), (2, 0, 7, 0, 13)}


def test_tests_are_searched_in_blocks(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "benchmark"))
    one, many = (decontaminate.search(docs, decontaminate.prepare(items, block_bytes=b)) for b in (1 << 20, 500))
    as_set = lambda df: {(r.doc_id, r.n_hit, tuple(sorted(r.item_ids)), r.contaminated) for r in df.collect()}
    assert as_set(one) == as_set(many)


def test_pipeline(spark, sf_dir):
    final = corpus_pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in final.collect()]
    assert len(ids) == len(set(ids)) and 100 < len(ids) < 200


def test_lm_noise_words_have_their_shares():
    import numpy as np

    from palimpsest.llm import lm_score as lm

    rng = np.random.default_rng(1)
    shares = rng.random((lm.CLASSES, lm.PER_CLASS)) ** 6
    shares[3] = 0
    shares[3, 5] = 1
    shares /= shares.sum(1, keepdims=True)
    model = lm.LogBilinear(np.full(lm.FIRST, 1 / lm.FIRST), shares.ravel().clip(1e-30))
    for c in (0, 3, lm.CLASSES - 1):
        got = np.bincount(model.noise_words(np.full(50_000, c), rng).ravel(), minlength=lm.OWN) / (50_000 * lm.WORD_NOISE)
        assert got.sum() == got[c * lm.PER_CLASS : (c + 1) * lm.PER_CLASS].sum()
        assert abs(got[c * lm.PER_CLASS : (c + 1) * lm.PER_CLASS] - shares[c]).max() < 0.006
