"""Hard-negative mining over one-dimensional distance keys.

The index: every vector, augmented so that inner products become distances (``vectors``), is filed under its nearest pivot by its
distance to it. Files are written in the order of (pivot, distance), as pages of up to ``PAGE`` vectors, each with the interval of
its keys. By the triangle inequality no vector of a page is nearer to a query than the gap between the page's interval and the
query's own distance to the pivot.

A search asks for the best rows of a query within a band of scores, an annulus around it. It goes outwards: a round visits the
pages whose gap lies between the last radius and the next one, pages within an annulus' hole left out, and merges what they have.
A band is certified when its k-th row, or its outer edge, is nearer than the radius: whatever wasn't visited lies beyond. Rounds
end when all bands are certified; each is a job over all open queries, in which pages are matrices and nothing but counts goes to
the driver.

Anchors are the rows that a condition on ``id`` names. Rows with a null id, label or vector, a null, NaN, infinite or too large
component take no part; shorter vectors are as if they ended in zeros; rows that repeat an id are one row (``vectors.prepared``);
equal scores rank by id; further columns are ignored; an empty table has no results, nor has an anchor without positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from ..operators.ranking import top_k
from ..operators.state import cut_round, scratch
from . import vectors
from .common import in_arrow
from .vectors import SLACK, Space

#: Vectors of a page at most, pivots at most, queries that are compared with a page at a time.
PAGE, PIVOTS, STEP = 1024, 64, 256
LOWEST, HIGHEST = -(2**62), 2**62
BANDS = "array<struct<band:int,low:long,high:long,least:long,have:int>>"


@dataclass(frozen=True)
class Index:
    """pages: (page, pivot, low, high, n, ids, labels, v) in files sorted by (pivot, low)."""

    pages: DataFrame
    space: Space


def build(rows: DataFrame, pivots: int = 0) -> Index:
    """The index of ``rows`` (id, v, label), written below the shared folder."""
    spark, at = rows.sparkSession, vectors.space(rows, pivots, PIVOTS)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = vectors.matrix(b.column(1), at.size)
                d = at.from_data(v)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), b.column(0), b.column(2), pa.array(vectors.packed(v), pa.binary())], ["pivot", "key", "id", "label", "v"])

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, None
        names = ["page", "pivot", "low", "high", "n", "ids", "labels", "v"]

        def page(t: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal made
            made += 1
            key, one = t.column(1), lambda x, kind: pa.array([x], kind)
            return pa.RecordBatch.from_arrays([one(base + made, pa.int64()), one(t.column(0)[0].as_py(), pa.int32()), one(key[0].as_py(), pa.float64()), one(key[-1].as_py(), pa.float64()), one(t.num_rows, pa.int32()), one(t.column(2).to_pylist(), pa.list_(pa.int64())), one(t.column(3).to_pylist(), pa.list_(pa.int32())), one(b"".join(t.column(4).to_pylist()), pa.binary())], names)

        for b in batches:
            if not b.num_rows:
                continue
            held = b if held is None else pa.concat_batches([held, b])
            pivot = held.column(0).to_numpy()
            ends = np.flatnonzero(np.r_[pivot[1:] != pivot[:-1], True]) + 1
            start = 0
            for end in ends:
                # the last run may go on in the next batch, so only its full pages are written now
                while end - start >= PAGE or start < end < len(pivot):
                    stop = min(start + PAGE, end)
                    yield page(held.slice(start, stop - start))
                    start = stop
            held = held.slice(start) if start < held.num_rows else None
        if held is not None:
            yield page(held)

    keys = in_arrow(rows.select("id", "v", "label"), keyed, "pivot int, key double, id long, label int, v binary")
    sorted_ = keys.repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id")
    schema = "page long, pivot int, low double, high double, n int, ids array<long>, labels array<int>, v binary"
    path = f"{scratch(spark, 'distance-keys')}/pages"
    in_arrow(sorted_, filed, schema).write.parquet(path)
    return Index(spark.read.schema(schema).parquet(path), at)


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(id, band, vec_id, score, rank) of the ``k`` best rows in each band of scores of each query (id, v, label, bands: array of
    (band, low, high), both included), of the query's own label, or of others; rows of the query's id are left out."""
    at = index.space
    known = cut_round(_placed(queries, at))
    directory = index.pages.select("page", "pivot", "low", "high")
    few = small(directory)
    # the first step of the radius, where a band has not yet k rows: the mean width of a page
    unit = float(directory.agg(F.avg(F.col("high") - F.col("low"))).first()[0] or 0) + 1.0
    found, state = None, cut_round(known.select("id", F.lit(-1.0).alias("last"), F.lit(unit).alias("width"), F.lit(1e300).alias("reach"), F.lit(False).alias("full"), F.lit(None).cast("array<struct<band:int,least:long,have:int>>").alias("so_far")))
    while state.limit(1).count():
        gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0)) * (1 - SLACK)
        # a full query goes straight to where its last row certifies it, another one a step beyond the nearest page that is left
        far = known.select("id", "inner", F.posexplode("far").alias("pivot", "d")).join(state.select("id", "last", "reach"), "id").join(few, "pivot")
        left = (gap > F.col("last")) & (F.col("high") + F.col("d") >= F.col("inner") * (1 - SLACK))
        nearest = far.filter(left & (gap <= F.col("reach"))).groupBy("id").agg(F.greatest(F.min(gap), F.max("inner")).alias("nearest"))
        aim = F.when(F.col("full"), F.col("reach")).otherwise(F.least("reach", F.col("nearest") + F.col("width")))
        state = cut_round(state.join(nearest, "id").withColumn("next", aim).drop("nearest"))
        open_ = known.join(state, "id")
        asked = open_.select("id", "v", "label", _merged("bands", "so_far").alias("bands"), "inner", "last", "next", F.posexplode("far").alias("pivot", "d"))
        visit = asked.join(few, "pivot").filter(left & (gap <= F.col("next")))
        visit = cut_round(visit.select("page", F.lit(1).alias("kind"), "id", "v", "label", "bands"))
        pages = index.pages.join(small(visit.select("page").distinct()), "page", "left_semi")
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        both = pages.select("page", F.lit(0).alias("kind"), none("id", "long"), "v", none("label", "int"), none("bands", BANDS), "ids", "labels").unionByName(visit.withColumn("ids", none("ids", "array<long>")).withColumn("labels", none("labels", "array<int>")))
        hits = in_arrow(both.repartition("page").sortWithinPartitions("page", "kind", "id"), _visit(at.size, k, same), "id long, band int, vec_id long, score long")
        every = hits if found is None else hits.unionByName(found.drop("rank"))
        found = cut_round(top_k(every, ["id", "band"], [F.col("score").desc(), F.col("vec_id")], k))
        state = cut_round(_next(open_, found, at, k))
    return found


def _placed(queries: DataFrame, at: Space) -> DataFrame:
    """Queries with their distance to each pivot, their squared length, and the inner edge of their bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = vectors.matrix(b.column(1), at.size)
                d = at.from_queries(q)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors.packed(q), pa.binary()), b.column(2), b.column(3), flat, pa.array((q * q).sum(1))], ["id", "v", "label", "bands", "far", "q2"])

    some = queries.filter(F.size("bands") > 0).select("id", "v", "label", F.transform("bands", lambda x: F.struct(x["band"].cast("int").alias("band"), x["low"].cast("long").alias("low"), x["high"].cast("long").alias("high"))).alias("bands"))
    placed = in_arrow(some, run, "id long, v binary, label int, bands array<struct<band:int,low:long,high:long>>, far array<double>, q2 double")
    return placed.withColumn("inner", _distance(F.array_max("bands.high"), at))


def _distance(score: Column, at: Space) -> Column:
    """How far from a query of squared length q2 what has ``score`` lies."""
    return F.sqrt(F.greatest(F.col("q2") + F.lit(at.m2) - 2.0 * score.cast("double"), F.lit(0.0)))


def _merged(bands: str, so_far: str) -> Column:
    """Bands with the lowest score that still counts and how many rows they have."""

    def one(x: Column) -> Column:
        own = F.get(F.filter(so_far, lambda y: y["band"] == x["band"]), F.lit(0))
        fields = {"band": x["band"], "low": x["low"], "high": x["high"], "least": F.coalesce(own["least"], F.lit(LOWEST).cast("long")), "have": F.coalesce(own["have"], F.lit(0))}
        return F.named_struct(*[c for k, c in fields.items() for c in (F.lit(k), c)])

    return F.transform(bands, one)


def _next(open_: DataFrame, found: DataFrame, at: Space, k: int) -> DataFrame:
    """The state of the queries that their radius doesn't certify yet."""
    have = found.groupBy("id", "band").agg(F.count("*").cast("int").alias("have"), F.min("score").alias("least"))
    have = have.groupBy("id").agg(F.collect_list(F.struct("band", "least", "have")).alias("now"))  # a query has few bands
    rows = open_.select("id", "bands", "q2", "next", "width").join(have, "id", "left").withColumn("b", _merged("bands", "now"))
    # how far a band may still have rows: to its k-th row, or to its outer edge
    edge = F.transform("b", lambda x: F.when(x["have"] >= k, F.greatest(x["least"], x["low"])).otherwise(x["low"]))
    reach = _distance(F.array_min(edge), at) * (1 + SLACK) + SLACK
    rows = rows.withColumn("reach", F.least(reach, F.sqrt("q2") + F.lit(2 * at.m2**0.5 + 1))).filter(F.col("reach") > F.col("next"))
    return rows.select("id", F.col("next").alias("last"), (2 * F.col("width")).alias("width"), "reach", F.forall("b", lambda x: x["have"] >= k).alias("full"), F.col("now").alias("so_far"))


def _visit(size: int, k: int, same: bool):
    """Over rows in order of (page, kind): a page, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, ids, labels, v = None, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            at, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (kind[1:] != kind[:-1]), True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if kind[lo] == 0:
                    page, ids, labels = at[lo], np.array(b.column(6)[lo].as_py(), np.int64), np.array(b.column(7)[lo].as_py(), np.int64)
                    v = np.frombuffer(b.column(3)[lo].as_py(), "<i4").reshape(len(ids), size).astype(np.float64)
                elif at[lo] == page:
                    for o in range(lo, hi, STEP):
                        out = _compare(b.slice(o, min(STEP, hi - o)), ids, labels, v, size, k, same)
                        if out.num_rows:
                            yield out

    return run


def _compare(asked: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, size: int, k: int, same: bool) -> pa.RecordBatch:
    own, label = asked.column(2).to_numpy(), asked.column(4).to_numpy()
    scores = vectors.dots(vectors.unpacked(asked.column(3), size), v)
    fits = ((label[:, None] == labels) == same) & (own[:, None] != ids)
    out = []
    bands = asked.column(5).to_pylist()
    for place in range(max(map(len, bands))):
        some = [x[place] if place < len(x) else None for x in bands]
        # a full band takes what is as good as its last; none where there is no such band
        low = np.array([HIGHEST if x is None else max(x["low"], x["least"] if x["have"] >= k else LOWEST) for x in some])
        high = np.array([LOWEST if x is None else x["high"] for x in some])
        q, i = np.nonzero(fits & (scores >= low[:, None]) & (scores <= high[:, None]))
        keep = vectors.best(q, scores[q, i], ids[i], k)
        q, i = q[keep], i[keep]
        number = np.array([-1 if x is None else x["band"] for x in some], np.int32)
        out.append((own[q], number[q], ids[i], scores[q, i]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "band", "vec_id", "score"])


def mine(df: DataFrame, anchors: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, pivots: int = 0, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score is from ``least`` to ``most`` per cent
    of the positive's. ``label`` is a condition on the columns of ``df``."""
    rows = vectors.prepared(df, scale, id_, vector, [label.cast("int").alias("label")]).filter("label IS NOT NULL")
    index = build(rows, pivots)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.space.rows:
        return df.sparkSession.createDataFrame([], schema)
    asked = cut_round(rows.filter(anchors))
    all_ = F.array(F.struct(F.lit(0).alias("band"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    near = search(index, asked.withColumn("bands", all_), positives, same=True)
    if near is None:
        return df.sparkSession.createDataFrame([], schema)
    near = near.select("id", F.col("rank").alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # the band of whole scores n with least * p <= 100 * n <= most * p
    band = near.select("id", F.struct("band", F.ceil(F.col("positive_score") * least / F.lit(100).cast("decimal(3,0)")).cast("long").alias("low"), F.floor(F.col("positive_score") * most / F.lit(100).cast("decimal(3,0)")).cast("long").alias("high")).alias("x")).filter("x.low <= x.high")
    bands = band.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("bands"))  # as many as positives, at most
    hard = search(index, asked.join(bands, "id"), negatives, same=False)
    if hard is None:
        return df.sparkSession.createDataFrame([], schema)
    out = hard.join(near, ["id", "band"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
