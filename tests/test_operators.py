"""Operators on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph, ingest, ranking, router, supersede, usage
from palimpsest.sources.tables import TenantScope, as_of
from palimpsest.streaming import jobs


def edges(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "from_id long, to_id long, kind string, confidence double")


def test_traverse_takes_simple_shortest_paths(spark):
    e = edges(spark, [(1, 2, "a"), (2, 3, "a"), (3, 1, "a"), (1, 3, "b"), (3, 4, "a")])
    got = {(r.entity_id, r.depth) for r in graph.traverse(spark.createDataFrame([(1,)], "seed_id long"), e, 3).collect()}
    assert got == {(2, 1), (3, 1), (4, 2)}
    only = graph.traverse(spark.createDataFrame([(1,)], "seed_id long"), e, 5, ["a"]).collect()
    assert {(r.entity_id, r.depth) for r in only} == {(2, 1), (3, 2), (4, 3)}
    assert [r.path for r in only if r.entity_id == 4] == [[1, 2, 3, 4]]


def test_loops_count_once(spark):
    assert {(r.entity_id, r.degree) for r in graph.degree(edges(spark, [(1, 1, "a"), (1, 2, "a")])).collect()} == {(1, 2), (2, 1)}


def test_current_values_of_a_one_to_one_kind_agree(spark):
    rows = [(1, "works_for", t, i, f"2024-01-{i + 1:02d}", None) for i, t in enumerate([5, 5, 6, 5, 5])] + [(1, "uses", t, i, f"2024-01-{i + 1:02d}", None) for i, t in enumerate([5, 6])]
    f = spark.createDataFrame(rows, "from_id long, kind string, to_id long, seq int, valid_at string, invalid_at string")
    h = graph.supersede(f)
    assert {r.to_id for r in h.filter("valid_to IS NULL AND kind = 'works_for'").collect()} == {5}
    assert h.filter("valid_to IS NULL AND kind = 'uses'").count() == 2
    assert [r.valid_to for r in h.filter("kind = 'works_for'").orderBy("seq").collect()] == ["2024-01-03", "2024-01-03", "2024-01-04", None, None]


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {(r.id, r.label) for r in graph.least_label(pairs).collect()}
    assert got == {(i, 1) for i in range(1, 41)} | {(x, 90) for x in (90, 95, 100)}


def test_long_chains_are_one_component(spark):
    # more links than any fixed number of rounds would walk; ids in no order
    ids = [(i * 7919) % 211 for i in range(200)]
    pairs = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    assert {(r.id, r.label) for r in graph.least_label(pairs).collect()} == {(i, min(ids)) for i in ids}


def test_semantic_supersede_is_the_walk_in_order(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    v = base[rng.integers(0, 12, 150)] + rng.normal(0, 0.25, (150, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, i, int(rng.integers(0, 2)), v[i].tolist() if i % 20 else None) for i in range(150)]
    rows += [(200 + i, 200 + i, 0, v[1].tolist()) for i in range(5)]  # copies
    pages = spark.createDataFrame(rows, "page_id long, seq long, label long, embedding array<float>")
    want, open_ = {r[0]: None for r in rows}, []
    for page, _, label, own in rows:
        if own is None:
            continue
        own = np.array(own, np.float32).astype(float)
        near = [(round(1 - float(o @ own), 9), p) for p, l, o in open_ if l == label and round(1 - float(o @ own), 9) <= 0.15]
        if near:
            gone = min(near)[1]
            want[gone] = page
            open_ = [x for x in open_ if x[0] != gone]
        open_.append((page, label, own))
    got = {r.page_id: r.superseded_by for r in ingest.semantic_supersede(pages, ["label"], 0.15).collect()}
    assert got == want
    assert sum(x is not None for x in want.values()) > 40
    # in two parts, the second against what the first left open
    first = supersede.closings(pages.filter("seq < 90"), ["label"], 0.15)
    open_ = pages.filter("seq < 90").join(first, "page_id", "left_anti").drop("seq")
    second = supersede.closings(pages.filter("seq >= 90"), ["label"], 0.15, open_)
    assert {r.page_id: r.superseded_by for r in first.union(second).collect()} == {k: v for k, v in want.items() if v is not None}


def walk(rows, near):
    """{closed: by} of (page_id, seq, scope, vector) in order, one after the other."""
    out, open_ = {}, []
    for page, _, own_scope, v in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[1], r[0])):
        v = np.array(v, np.float32).astype(float)
        d = [(round(1 - float(o @ v), 9), p) for p, s, o in open_ if s == own_scope and len(o) == len(v)]
        d = [x for x in d if x[0] <= near]
        if d:
            gone = min(d)[1]
            out[gone] = page
            open_ = [x for x in open_ if x[0] != gone]
        open_.append((page, own_scope, v))
    return out


def test_supersede_of_copies_and_dense_pages_takes_few_rounds(spark, monkeypatch):
    """Hundreds of copies, which a walk takes one by one, pages that are nearly all near each other, and odd rows."""
    rng = np.random.default_rng(7)
    unit = lambda x: (x / np.linalg.norm(x, axis=-1, keepdims=True)).tolist()
    copies = [(i, 1000 - i % 500, "a", unit(np.arange(1.0, 9.0))) for i in range(500)]
    dense = [(1000 + i, i, None, v) for i, v in enumerate(unit(rng.normal(size=(300, 8)) + 1.0))]
    odd = [(2000, 5, "a", None), (2001, 5, "b", [1.0, 0.0]), (2002, 4, "b", [1.0, 0.0]), (2003, 6, "b", [1.0, 0.0, 0.0]), (2004, 6, "b", [1.0, 0.0])]
    rows = copies + dense + odd
    pages = spark.createDataFrame(rows, "page_id long, seq long, label string, embedding array<float>").repartition(3)
    monkeypatch.setattr(supersede, "SLICE", 64)
    found, rounds = supersede.matched(supersede.near_pairs(pages, ["label"], 0.2))
    want = walk(rows, 0.2)
    assert {r.early: r.late for r in found.collect()} == want and len(want) > 700
    assert rounds <= 15
    assert supersede.closings(pages.limit(0), ["label"], 0.2).count() == 0


def test_dense_pages_are_walked_without_their_pairs(spark, monkeypatch):
    """Nearly all pages are within reach of each other: no pairs are made. Where too many stay open, the rest goes by pairs."""
    rng = np.random.default_rng(8)
    unit = lambda x: (x / np.linalg.norm(x, axis=-1, keepdims=True)).tolist()
    rows = [(i, 1000 - i % 500, "a", v) for i, v in enumerate(unit(rng.normal(size=(600, 8)) + 1.0))] + [(2000 + i, i, None, v) for i, v in enumerate(unit(rng.normal(size=(60, 8)) + 1.0))]
    rows += [(3000 + i, i // 2, "b", v) for i, v in enumerate(unit(rng.normal(size=(200, 8))))] + [(4000, 7, "a", None), (4001, 9, "b", [1.0, 0.0])]
    pages = spark.createDataFrame(rows, "page_id long, seq long, label string, embedding array<float>").repartition(3)
    want, real = walk(rows, 0.2), supersede.near_pairs
    monkeypatch.setattr(supersede, "ARRIVING", 50)
    monkeypatch.setattr(supersede, "near_pairs", None)
    assert {r.page_id: r.superseded_by for r in supersede.closings(pages, ["label"], 0.2).collect()} == want and len(want) > 600
    met = []
    monkeypatch.setattr(supersede, "OPEN", 40)
    monkeypatch.setattr(supersede, "near_pairs", lambda *x: (met.append(x[0].count()), real(*x))[1])
    assert {r.page_id: r.superseded_by for r in supersede.closings(pages, ["label"], 0.2).collect()} == want
    assert 50 < met[0] < 800  # only what was left where a walk stopped


def test_near_pairs_visit_few_cells(spark):
    """All pairs within reach, from cells that few pages visit."""
    rng = np.random.default_rng(3)
    at = rng.normal(size=(30, 16))
    v = at[np.arange(600) % 30] + rng.normal(size=(600, 16)) * 0.03
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    pages = spark.createDataFrame([(i, i, 0, x.tolist()) for i, x in enumerate(v)], "page_id long, seq long, s int, embedding array<float>")
    d = np.round(1 - v.astype(float) @ v.astype(float).T, 9)
    want = {(i, j) for i in range(600) for j in range(i) if d[i, j] <= 0.01}
    assert {(r.late, r.early) for r in supersede.near_pairs(pages, ["s"], 0.01).collect()} == want and len(want) > 2000
    pivots = v[rng.choice(600, 25, replace=False)].astype(float)
    visits = [len(c) for _, c in supersede._cells(v.astype(float), pivots, np.sqrt(0.02))]
    assert np.mean(visits) < 12


def test_cap_with_backfill_fills_up(spark):
    df = spark.createDataFrame([(1, i, "p" if i < 6 else "q", i) for i in range(1, 8)], "q int, item int, page string, rank int")
    got = ranking.cap_with_backfill(df, ["q"], "page", 2, 5).orderBy("position").collect()
    assert [r.item for r in got] == [1, 2, 6, 7, 3]


def test_dedup_is_idempotent(spark):
    new = spark.createDataFrame([(1, "m", "h"), (2, "m", "h"), (3, "n", "h"), (4, None, "h")], "page_id int, domain string, content_hash string")
    first = ingest.exact_dedup(new, new.limit(0), ["domain"], ["page_id"])
    assert {r.page_id for r in first.collect()} == {1, 3, 4}
    assert ingest.exact_dedup(new, first, ["domain"], ["page_id"]).count() == 0


def test_half_open_snapshots_and_scope(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-02-01"), (2, "2024-02-01", None)], "organization_id int, f string, t string").select("organization_id", F.col("f").cast("timestamp").alias("valid_from"), F.col("t").cast("timestamp").alias("valid_to"))
    assert [r.organization_id for r in as_of(df, "2024-02-01").collect()] == [2]
    assert TenantScope(1)(df).count() == 1


def test_bucket_refills(spark):
    rows = [(1, i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 0, 0, 30, 30])]
    r = spark.createDataFrame(rows, "k int, event_id long, t string").select("k", "event_id", F.col("t").cast("timestamp").alias("ts"))
    got = {x.event_id: x.admitted for x in usage.token_bucket(r, "k", 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_fusion_does_not_depend_on_order(spark):
    rows = [(1, i, c, r, 1.0) for i, c, r in ((1, "a", 1), (2, "a", 2), (1, "b", 2), (3, "b", 1))]
    a, b = (spark.createDataFrame(x, "q int, item int, channel string, rank int, weight double") for x in (rows, rows[::-1]))
    as_set = lambda d: {(r.item, round(r.score, 12)) for r in ranking.fuse(d, ["q"], "item").collect()}
    assert as_set(a) == as_set(b)


def test_providers_are_asked_in_order(spark):
    calls = spark.sparkContext.accumulator(0)

    def provider(name, fail):
        def make():
            def model(text):
                calls.add(1)
                if text in fail:
                    raise fail[text]
                return f"{name} {text}"

            return model

        return router.Provider(name, make)

    first = provider("a", {"t": TimeoutError("slow"), "x": router.Failure(404), "y": router.Failure(500), "z": router.Failure(429), "bug": ValueError("bad prompt")})
    second = provider("b", {"y": router.Failure(502), "z": router.Failure(403)})
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["ok", "t", "x", "y", "z", "bug", None])], "id int, prompt string").coalesce(1)
    got = {r.id: (r.answer, r.provider, r.tier, r.calls, r.error) for r in router.answered(rows, [first, second], attempts=2).collect()}
    assert got == {
        0: ("a ok", "a", 0, 1, None), 1: ("b t", "b", 1, 3, None), 2: (None, None, None, 1, "a: status 404"), 3: (None, None, None, 4, "b: status 502"),
        4: (None, None, None, 3, "b: status 403"), 5: (None, None, None, 1, "a: bad prompt"), 6: (None,) * 5,
    }
    assert calls.value == 13
    with pytest.raises(ValueError, match="no provider"):
        router.answered(rows, [])


def test_pages_know_what_is_left(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "n int")
    of = lambda limit, offset: [(r.n, r.position, r.total, r.has_more) for r in ranking.page(df, [F.desc("n")], limit, offset).orderBy("position").collect()]
    assert of(3, 2) == [(4, 3, 7, True), (3, 4, 7, True), (2, 5, 7, True)]
    assert of(3, 4) == [(2, 5, 7, False), (1, 6, 7, False), (0, 7, 7, False)] and of(3, 9) == []


def test_streamed_pages_close_what_a_walk_closes(spark, tmp_path):
    """Two batches of new pages: exact repeats go, the rest closes the nearest open page of its domain, of this batch or before."""
    rng = np.random.default_rng(5)
    at = rng.normal(size=(6, 8))
    v = at[rng.integers(0, 6, 60)] + rng.normal(0, 0.1, (60, 8))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    rows = [(i, "memory" if i % 3 else "guideline", f"Text {i % 51}", v[i].tolist()) for i in range(60)]
    for part in (rows[:35], rows[35:]):
        spark.createDataFrame(part, "page_id long, domain string, content string, embedding array<float>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = str(tmp_path / "out")
    kept = jobs.ingest_pages(jobs.stream(spark, f"{tmp_path}/in", 1), out, near=0.1, chunks=ingest.fixed_chunks)
    seen, fresh = set(), []
    for r in rows:
        if (r[1], r[2]) not in seen:
            seen.add((r[1], r[2]))
            fresh.append((r[0], r[0], r[1], r[3]))
    assert {r.page_id for r in kept.collect()} == {r[0] for r in fresh}
    closed = spark.read.schema("page_id long, superseded_by long").option("recursiveFileLookup", True).parquet(f"{out}/closed")
    want = walk(fresh, 0.1)
    assert {r.page_id: r.superseded_by for r in closed.collect()} == want and len(want) > 10


def test_a_compiled_page_replaces_the_most_similar(spark, monkeypatch):
    """Slugs first, then the best text of the scope at 0.6 or more; few pairs are looked at."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6))
    texts = [[word() for _ in range(40)] for _ in range(150)]

    def near(ws, n):
        ws = list(ws)
        for i in rng.choice(len(ws), n, replace=False):
            ws[i] = word()
        return " ".join(ws)

    old = [(i, "s" if i % 2 else "t", f"o{i}", near(w, 0)) for i, w in enumerate(texts)] + [(900, "s", "o1x", near(texts[1], 0)), (901, "s", "o3x", "")]
    new = [(1000 + i, "s" if i % 2 else "t", f"n{i}", near(w, int(rng.integers(0, 25)))) for i, w in enumerate(texts[:100])]
    new += [(2000, "s", "o5", "whatever"), (2001, "t", "o5", "nothing"), (2002, "s", "zz", ""), (2003, "s", "copy", near(texts[1], 0)), (2004, "s", "copy2", near(texts[1], 0))]

    def grams(s):
        return {("  " + w + " ")[i : i + 3] for w in s.lower().split() for i in range(len(w) + 1)}

    want = {}
    for i, scope, slug, text in new:
        mates = [o for o in old if o[1] == scope]
        same_slug = [o[0] for o in mates if o[2] == slug]
        a = grams(text[:500])
        best = sorted((-round(len(a & b) / len(a | b), 9), o[0]) for o in mates if a and (b := grams(o[3][:500])) and round(len(a & b) / len(a | b), 9) >= 0.6)
        want[i] = min(same_slug) if same_slug else best[0][1] if best else None
    seen = []
    real = ingest.upsert_candidates
    monkeypatch.setattr(ingest, "upsert_candidates", lambda *x: (seen.append((r := real(*x)).count()), r)[1])
    schema = "id long, scope string, slug string, content string"
    got = {r.id: r.target for r in ingest.compiled_upsert(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    assert got == want and 50 < sum(x is not None for x in want.values()) < 100
    assert sum(seen) < 0.05 * len(new) * len(old) / 2


def test_upsert_in_blocks_finds_what_rare_trigrams_find(spark, monkeypatch):
    """Texts of few trigrams, nearly all of which are candidates, and blocks smaller than a scope."""
    rng = np.random.default_rng(11)
    parts = ["ban", "ana", "nab", "aé", "𝄞x"]
    text = lambda: " ".join("".join(rng.choice(parts, 3)) for _ in range(int(rng.integers(1, 6))))
    old = [(i, "s" if i % 3 else "t", f"o{i}", text()) for i in range(150)]
    new = [(1000 + i, "s" if i % 2 else "t", f"n{i}", old[i][3] if i % 7 == 0 else text()) for i in range(90)] + [(2000, "u", "n", "alone"), (2001, "s", "n", "")]
    schema = "id long, scope string, slug string, content string"
    a, b = spark.createDataFrame(new, schema).repartition(3), spark.createDataFrame(old, schema).repartition(3)
    want = {r.id: r.target for r in ingest.compiled_upsert(a, b).collect()}
    for name, value in {"MEETINGS": 0, "SHARED": 0, "ASKED": 20, "STORED": 30, "SETS": 7, "GRAMS": 5}.items():
        monkeypatch.setattr(ingest, name, value)
    monkeypatch.setattr(ingest, "upsert_candidates", None)
    assert {r.id: r.target for r in ingest.compiled_upsert(a, b).collect()} == want and sum(x is not None for x in want.values()) > 30


def test_an_upsert_stores_a_row_a_set(spark, monkeypatch):
    """Neither trigrams nor candidates are stored as rows, with blocks and without."""
    rng = np.random.default_rng(12)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(30))
    old = [(i, "st"[i % 2], f"o{i}", text()) for i in range(60)]
    new = [(1000 + i, "st"[i % 2], f"n{i}", old[i][3] + " end" if i % 3 else text()) for i in range(40)]
    schema = "id long, scope string, slug string, content string"
    a, b = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    rows = []
    for name in ("cut", "cut_round"):
        if real := getattr(ingest, name, None):
            monkeypatch.setattr(ingest, name, lambda df, real=real: (r := real(df), rows.append(r.count()))[0])
    want = {i: i - 1000 if i % 1000 % 3 else None for i in range(1000, 1040)}
    assert {r.id: r.target for r in ingest.compiled_upsert(a, b).collect()} == want
    for name, value in {"MEETINGS": 0, "SHARED": 0, "SETS": 7, "GRAMS": 20}.items():
        monkeypatch.setattr(ingest, name, value)
    assert {r.id: r.target for r in ingest.compiled_upsert(a, b).collect()} == want
    assert max(rows) <= len(old)


def test_rare_trigrams_in_common_are_looked_up_or_multiplied(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(13)
    side = lambda: [sorted(rng.choice(50, int(rng.integers(0, 9)), replace=False).tolist()) for _ in range(30)]
    x, y = side(), side()
    made = lambda s: ingest._Sets([pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([len(v) for v in s], pa.int32()), pa.array([b""] * 30, pa.binary()), pa.array(s, pa.list_(pa.int64()))], ["id", "n", "bits", "rare"])])
    a, b = made(x), made(y)
    monkeypatch.setattr(ingest, "COLUMNS", 16)
    monkeypatch.setattr(ingest, "LOOKED", 5)
    i, j = (v.ravel() for v in np.mgrid[0:20, 0:30])
    for some in (slice(None), slice(7, 8), slice(0, 600, 37)):
        for looked in (0, 2000):
            monkeypatch.setattr(ingest, "DEARER", looked)
            assert ingest._rare_in_common(a, b, 10, 30, i[some], j[some]).tolist() == [len(set(x[10 + p]) & set(y[q])) for p, q in zip(i[some], j[some], strict=True)]


def test_rounds_of_matching_broadcast_hot_keys_only(spark, monkeypatch):
    """What a round broadcasts is sent to the driver, and rounds add up."""
    plans, real = [], supersede.cut_round
    monkeypatch.setattr(supersede, "cut_round", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    pairs = spark.createDataFrame([(i, i, j, (i * j % 7) / 10) for i in range(1, 20) for j in range(i)], "late long, at long, early long, distance double")
    assert supersede.matched(pairs)[0].count() > 5
    # of each round, the two lookups' hot keys
    assert max(p.count("BroadcastHashJoin") for p in plans) == 2 and sum("BroadcastHashJoin" in p for p in plans) <= len(plans) / 5
