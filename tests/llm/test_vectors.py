"""Vector operators against plain versions: ties, repeated rows and ids, nulls, odd lengths, hot vectors, empty tables, extra columns."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives, knn_join, vectors, yinyang

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, score long, _n int"


def made(rows):
    return [(i, e, l, "x", 1, None, 2) for i, e, l in rows]


@pytest.fixture(scope="module")
def rows():
    """300 clustered vectors of 8 components, a vector that a third of the rows share, and odd rows."""
    r = np.random.default_rng(5)
    centers = r.normal(size=(6, 8))
    out = []
    for i in range(300):
        e = centers[0] if i % 3 == 0 else centers[r.integers(6)] + r.normal(size=8) * 0.2
        out.append((i, [float(np.float32(x)) for x in e], int(r.integers(4)) if i % 11 else None))
    inf, nan = float("inf"), float("nan")
    out += [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1020, [inf] * 8, 1), (1040, [nan] * 8, 2), (1060, [0.0] * 8, 2), (None, [1.0] * 8, 1), (1100, [1.0, 2.0], 0), (1120, [], 1), (1140, [3e38] * 8, 1), (20, out[20][1], out[20][2]), (40, [9.0] * 8, 3)]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(made(rows), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def taking_part(rows, scale):
    """{id: (vector, label)} of whole vectors, one for each id, padded to the longest."""
    out = {}
    for i, e, l in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) or abs(x * scale) >= vectors.MOST for x in e):
            continue
        v = [math.floor(scale * x) for x in e]
        out[i] = min(out.get(i, (v, l)), (v, l), key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    return {i: (v + [0] * (8 - len(v)), l) for i, (v, l) in out.items()}


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("pivots", "block"), [(0, 512), (7, 4), (64, 16)])
def test_knn_join(df, rows, pivots, block):
    every = taking_part(rows, 64)
    want = set()
    for q, (v, _) in every.items():
        if q % 20 == 0:
            best = sorted((-dot(v, w), i) for i, (w, _) in every.items() if i != q)[:20]
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = knn_join.search(df, F.col("id") % 20 == 0, 20, 64, pivots, block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_knn_join_sends_only_what_a_group_may_need(spark):
    """Far clusters are not sent to each other's groups."""
    r = np.random.default_rng(1)
    at = r.normal(size=(4, 8)) * 100
    data = [(i, [float(x) for x in at[i % 4] + r.normal(size=8)], 0) for i in range(400)]
    prepared = vectors.prepared(spark.createDataFrame(made(data), SCHEMA), 64)
    space = vectors.space(prepared, 32, 64)
    asked = knn_join._asked(prepared.filter("id % 4 = 1"), space, 5).cache()
    reach, counts = knn_join._summaries(asked, space)
    group, blocks = knn_join._groups(space, counts, 1000)
    sent = knn_join._sent(prepared, space, reach, group, blocks, 1)
    assert 6 <= sent.count() <= 100 and sent.filter("id % 4 <> 1").count() == 0
    every = taking_part(data, 64)
    got = knn_join.search(spark.createDataFrame(made(data), SCHEMA), F.col("id") % 4 == 1, 5, 64, 32)
    want = {(q, -s, i) for q in every if q % 4 == 1 for s, i in sorted((-dot(every[q][0], w), i) for i, (w, _) in every.items() if i != q)[:5]}
    assert {(r.query_id, r.score, r.vec_id) for r in got.collect()} == want


def test_knn_join_small(spark, none):
    every = F.col("id") >= 0
    assert knn_join.search(none, every, 20, 64).count() == 0
    one = spark.createDataFrame(made([(1, [1.0, 2.0], 0)]), SCHEMA)
    assert knn_join.search(one, every, 20, 64).count() == 0
    assert knn_join.search(one, F.col("id") > 5, 20, 64).count() == 0
    two = spark.createDataFrame(made([(1, [1.0, 2.0], 0), (2, [3.0], 0)]), SCHEMA)
    assert {tuple(r) for r in knn_join.search(two, every, 20, 64).collect()} == {(1, 1, 2, 64 * 192), (2, 1, 1, 64 * 192)}
    large = spark.createDataFrame(made([(1, [2.0**20, 1.0], 0), (2, [2.0**20, 2.0**20 - 1], 0)]), SCHEMA)
    assert {r.score for r in knn_join.search(large, every, 20, 64).collect()} == {2**52 + 64 * (2**26 - 64)}


def plain_negatives(every, anchors, positives=5, negatives=3):
    out = set()
    for a, (v, l) in every.items():
        if a % anchors:
            continue
        others = sorted((-dot(v, w), i, m) for i, (w, m) in every.items() if i != a)
        for p, i, _ in [x for x in others if x[2] == l][:positives]:
            fits = [x for x in others if x[2] != l and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
            out |= {(a, i, r, n, -p, -s) for r, (s, n, _) in enumerate(fits, 1)}
    return out


@pytest.mark.parametrize("pivots", [0, 3])
def test_hard_negatives(df, rows, pivots, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PAGE", 16)
    got = hard_negatives.mine(df, F.col("id") % 10 == 0, F.col("label"), pivots=pivots)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    # labels are part of which of two rows with an id counts, and rows without a label go afterwards
    every = {i: x for i, x in taking_part(rows, 256).items() if x[1] is not None}
    want = plain_negatives(every, 10)
    assert len(want) > 50 and len(found) == len(want) and set(found) == want


def test_hard_negatives_visit_few_pages(spark, monkeypatch):
    """Clusters far apart: the pages that rounds visit are few, and the result is that of a full scan."""
    r = np.random.default_rng(2)
    at = r.normal(size=(10, 8)) * 20
    data = [(i, [float(np.float32(x)) for x in at[i % 10] + r.normal(size=8)], int(r.integers(2))) for i in range(2000)]
    visited = []
    real = hard_negatives._visit

    def counted(*a):
        run = real(*a)
        total = spark.sparkContext.accumulator(0)
        visited.append(total)

        def one(batches):
            def seen(b):
                total.add(sum(b.column(1).to_pylist()))
                return b

            yield from run(seen(b) for b in batches)

        return one

    monkeypatch.setattr(hard_negatives, "PAGE", 20)
    monkeypatch.setattr(hard_negatives, "_visit", counted)
    df = spark.createDataFrame(made(data), SCHEMA)
    index = hard_negatives.build(vectors.prepared(df, 256, extra=[F.col("label")]))
    pages = index.pages.count()
    assert index.pages.agg(F.sum("n")).first()[0] == 2000
    band = F.array(F.struct(F.lit(0).alias("band"), F.lit(hard_negatives.LOWEST).alias("low"), F.lit(hard_negatives.HIGHEST).alias("high")))
    asked = vectors.prepared(df, 256, extra=[F.col("label")]).filter("id % 100 = 0").withColumn("bands", band)
    got = {(x.id, x.rank, x.vec_id) for x in hard_negatives.search(index, asked, 3, same=False).collect()}
    every = {i: (v, l) for i, (v, l) in taking_part(data, 256).items()}
    want = set()
    for q in range(0, 2000, 100):
        best = sorted((-dot(every[q][0], w), i) for i, (w, m) in every.items() if i != q and m != every[q][1])[:3]
        want |= {(q, k, i) for k, (_, i) in enumerate(best, 1)}
    assert got == want
    assert len(visited) >= 2 and sum(x.value for x in visited) < 0.5 * 20 * pages


def test_hard_negatives_small(spark, none):
    every = F.col("id") >= 0
    assert hard_negatives.mine(none, every, F.col("label")).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(made([(1, [1.0], 0)]), SCHEMA), every, F.col("label")).count() == 0
    # a positive of negative score has no band, one of score 0 only negatives of score 0
    few = spark.createDataFrame(made([(1, [1.0, 0.0], 0), (2, [-1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [0.0, 2.0], 1), (5, [0.5, 1.0], 1)]), SCHEMA)
    got = {tuple(r) for r in hard_negatives.mine(few, F.col("id") == 1, F.col("label")).collect()}
    assert got == {(1, 3, 1, 4, 0, 0)}


def plain_clusters(vecs, ids, k, rounds):
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), vecs[i]))
    centers = [vecs[i] for i in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [nearest(v)[1] for v in vecs]
        for j in range(len(centers)):
            some = [v for v, o in zip(vecs, own, strict=True) if o == j]
            if some:
                centers[j] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    return [nearest(v) for v in vecs], centers


@pytest.mark.parametrize("groups", [1, 2, 8])
def test_yinyang(df, rows, groups):
    some = [(i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows if e and len(e) == 8 and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in e)]
    want, centers = plain_clusters([v for _, v in some], [i for i, _ in some], 8, 10)
    found, got = yinyang.cluster(df, groups=groups, size=8)
    assert got.tolist() == centers
    key = lambda r: (r[0] is None, r)
    rows_ = sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=key)
    assert rows_ == sorted(((i, j, d) for (i, _), (d, j) in zip(some, want, strict=True)), key=key)
    report = yinyang.report(found, got)
    assert report.count() == len(some)
    inertia = {r.inertia for r in report.collect()}
    assert inertia == {sum(d for d, _ in want)}


def test_yinyang_small(spark, none):
    assert yinyang.report(*yinyang.cluster(none, size=2)).count() == 0
    two = spark.createDataFrame(made([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [1.0], 0)]), SCHEMA)
    found, centers = yinyang.cluster(two, size=2)
    # of equal centroids the smaller number has all
    assert [(r.vec_id, r.cluster, r.distance) for r in found.orderBy("vec_id").collect()] == [(1, 0, 0), (2, 0, 0)] and len(centers) == 2


def test_yinyang_bounds_hold_and_save_distances():
    """Every round's assignment is a full scan's, and far fewer distances are computed."""
    r = np.random.default_rng(9)
    v = np.floor(r.normal(size=(3000, 6)) * 40 + r.integers(0, 12, 3000)[:, None] * 90).astype(float)
    centers = np.unique(v[r.choice(3000, 24, replace=False)].astype(np.int64), axis=0)
    group = yinyang.grouped(centers, 4)
    own, d, lower = yinyang._first(v, centers, group)
    upper, seen = np.sqrt(d.astype(float)) * (1 + vectors.SLACK), 0
    for _ in range(12):
        moved = np.array([np.floor(v[own == c].mean(0)) if (own == c).any() else centers[c] for c in range(len(centers))]).astype(np.int64)
        drift = np.sqrt(((moved - centers) ** 2).sum(1).astype(float)) * (1 + vectors.SLACK)
        centers = moved
        own, upper, lower, n = yinyang.assign(v, own, upper, lower, centers, group, drift)
        seen += n
        full = yinyang.squares(v, centers)
        assert (own == full.argmin(1)).all()
        at = np.arange(len(v))
        assert (upper >= np.sqrt(full[at, own])).all()
        full = np.sqrt(full.astype(float))
        full[at, own] = np.inf
        for g in range(group.max() + 1):
            assert (lower[:, g] <= full[:, group == g].min(1, initial=np.inf)).all()
    assert seen < 0.5 * 12 * len(v) * len(centers)
