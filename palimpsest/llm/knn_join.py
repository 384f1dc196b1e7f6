"""Exact top-k search by a Voronoi kNN join.

Pivots are a bounded sample of the rows. Each vector belongs to the cell of its nearest pivot, and so does each query. Of every
cell of queries a summary is kept: the range of its distances to each pivot, how far each pivot's border is, and the largest
distance within which its queries' k-th neighbour is known to lie (as pivots are rows, a query's k+1 highest scores with pivots
bound it). A vector is sent to a group of queries only if the triangle inequality or the border of its cell leave it within that
distance. Groups are cells, small ones together, large ones in blocks; the vectors of a group are dealt out in slices, to which
its queries are sent, so no group and no cell is one task's. Each slice is solved in matrix blocks; a query's best rows of all
slices are merged.

Queries are all rows that a condition names, candidates are all rows but those with the query's own id. Rows with a null id or
vector, a null, NaN, infinite or too large component take no part; shorter vectors are as if they ended in zeros; rows that repeat
an id are one row (``vectors.prepared``); equal scores rank by id; further columns are ignored; an empty table has no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import top_k
from ..operators.state import cut_round
from . import vectors
from .common import in_arrow
from .vectors import SLACK, Space

#: Pivots at most, so that summaries, a row for each pair of them, stay small.
PIVOTS = 512
#: Queries of a group at most, and vectors that are compared with a group at a time.
BLOCK, STEP = 512, 2048
#: Vectors of a slice of a group, about.
SLICE = 1 << 16


def search(df: DataFrame, queries: Column, k: int, scale: int, pivots: int = 0, block: int = BLOCK, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` highest inner products of floor(scale * x) for each row that ``queries``, a
    condition on ``id``, holds for."""
    spark = df.sparkSession
    rows = vectors.prepared(df, scale, id_, vector)
    at = vectors.space(rows, pivots, PIVOTS)
    if not at.rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = cut_round(_asked(rows.filter(queries), at, k))
    reach, counts = _summaries(asked, at)
    group, blocks = _groups(at, counts, block)
    groups = int((group + blocks).max(initial=0))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-at.rows // SLICE), -(-parts // max(groups, 1)))
    sent = _sent(rows, at, reach, group, blocks, slices)
    cell = spark.createDataFrame([(int(c), int(group[c]), int(blocks[c])) for c in np.flatnonzero(counts)], "cell int, first int, blocks int")
    here = asked.join(F.broadcast(cell), "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "id", "v", "least")
    both = here.unionByName(sent).repartition("grp", "slice").sortWithinPartitions("grp", "slice", "kind", "id")
    found = in_arrow(both, _solve(at.size, k), "query_id long, vec_id long, score long")
    best = top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _asked(queries: DataFrame, at: Space, k: int) -> DataFrame:
    """(id, v, cell, least, far, d) of queries: their cell, a score that k candidates reach, its distance, those of all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = vectors.matrix(b.column(1), at.size)
            scores = vectors.dots(q, at.pivots)
            d = at.from_queries(q, scores)
            # one of the k + 1 may be the query's own row
            few = scores.shape[1] <= k
            least = np.full(len(q), -(2**63)) if few else -np.partition(-scores, k, axis=1)[:, k]
            far = np.full(len(q), np.inf) if few else at.from_queries(q, least[:, None].astype(float))[:, 0]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors.packed(q), pa.binary()), pa.array(d.argmin(1).astype(np.int32)), pa.array(least.astype(np.int64)), pa.array(far), flat], ["id", "v", "cell", "least", "far", "d"])

    return in_arrow(queries.select("id", "v"), run, "id long, v binary, cell int, least long, far double, d array<double>")


def _summaries(asked: DataFrame, at: Space) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """((far by cell, low, high, border by cell and pivot), queries by cell): as many rows as pivots, squared."""
    p = len(at.pivots)
    far, low, high, border, counts = np.zeros(p), np.full((p, p), np.inf), np.zeros((p, p)), np.full((p, p), np.inf), np.zeros(p, np.int64)
    for c, f, n in asked.groupBy("cell").agg(F.max("far"), F.count("*")).collect():
        far[c], counts[c] = f, n
    each = asked.select("cell", F.element_at("d", F.col("cell") + 1).alias("own"), F.posexplode("d").alias("pivot", "x"))
    for c, j, lo, hi, edge in each.groupBy("cell", "pivot").agg(F.min("x"), F.max("x"), F.min(F.col("x") * F.col("x") - F.col("own") * F.col("own"))).collect():
        low[c, j], high[c, j], border[c, j] = lo, hi, edge
    between = at.from_data(at.pivots)
    # a query of cell i is at least as far from cell j as from the border of both
    with np.errstate(divide="ignore", invalid="ignore"):
        border = np.where(between > 0, border / (2 * between), 0.0)
    return (far, low, high, border), counts


def _groups(at: Space, counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each cell: cells that lie side by side share a group of up to ``block`` queries, a
    larger cell has groups of its own, over which its queries are dealt."""
    between, left = at.from_data(at.pivots), set(np.flatnonzero(counts).tolist())
    group, blocks = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    here, filled, current = None, block, -1
    top = -1
    while left:
        here = min(left, key=lambda c: (between[here, c] if here is not None else 0, c))  # noqa: B023
        left.remove(here)
        n = int(counts[here])
        if n > block:
            group[here], blocks[here] = top + 1, -(-n // block)
            top += int(blocks[here])
            continue
        if filled + n > block:
            top += 1
            current, filled = top, 0
        group[here], blocks[here], filled = current, 1, filled + n
    return group, blocks


def _sent(rows: DataFrame, at: Space, reach: tuple[np.ndarray, ...], group: np.ndarray, blocks: np.ndarray, slices: int) -> DataFrame:
    """Rows (grp, slice, kind, id, v, least) of vectors, one for each group that may need it."""
    far, low, high, border = reach
    cells = np.flatnonzero(blocks)
    far, low, high, border = far[cells], low[cells], high[cells], border[cells]
    bound = far * (1 + SLACK) + SLACK
    firsts = np.unique(group[cells])
    # of which groups each cell is part: a shared group counts once, though several of its cells need a vector
    member = (group[cells][:, None] == firsts).astype(np.float32)
    count = np.array([blocks[cells][group[cells] == f].max() for f in firsts], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for off in range(0, b.num_rows, 4 * STEP):
                part = b.slice(off, 4 * STEP)
                ids, v = part.column(0).to_numpy(), vectors.matrix(part.column(1), at.size)
                d = at.from_data(v)
                cell = d.argmin(1)
                own = d[np.arange(len(v)), cell]
                least = np.maximum(np.maximum(low[:, cell] - own, own - high[:, cell]), border[:, cell])
                need = (member.T @ (least * (1 - SLACK) <= bound[:, None]).astype(np.float32)) > 0
                at_group, at_row = np.nonzero(need)
                times = count[at_group]
                r = np.repeat(at_row, times)
                g = np.repeat(firsts[at_group], times) + np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
                slice_ = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slices
                payload = pa.array(vectors.packed(v), pa.binary())
                for o in range(0, len(r), 16 * STEP):
                    x = r[o : o + 16 * STEP]
                    yield pa.RecordBatch.from_arrays([pa.array(g[o : o + 16 * STEP].astype(np.int32)), pa.array(slice_[x].astype(np.int32)), pa.array(np.ones(len(x), np.int32)), pa.array(ids[x]), payload.take(pa.array(x)), pa.nulls(len(x), pa.int64())], ["grp", "slice", "kind", "id", "v", "least"])

    return in_arrow(rows.select("id", "v"), run, "grp int, slice int, kind int, id long, v binary, least long")


def _solve(size: int, k: int):
    """Over rows in order of (group, slice, kind, id): the queries of a slice, then its vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, solver = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy().astype(np.int64)
            kind = b.column(2).to_numpy()
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if key[lo] != now:
                    if solver:
                        yield solver.out()
                    now, held, solver = key[lo], [], None
                ids, v = b.column(3).slice(lo, hi - lo).to_numpy(), vectors.unpacked(b.column(4).slice(lo, hi - lo), size)
                if kind[lo] == 0:
                    held.append((ids, v, b.column(5).slice(lo, hi - lo).to_numpy()))
                elif held:
                    solver = solver or _Block(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                    for o in range(0, len(ids), STEP):
                        solver.add(ids[o : o + STEP], v[o : o + STEP])
        if solver:
            yield solver.out()

    return run


class _Block:
    """The best rows so far of a block of queries. Vectors come in order of their ids, so one that only equals the k-th is out."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.over = np.maximum(least, -(2**63) + 1) - 1
        self.query, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        s = vectors.dots(self.v, v)
        q, i = np.nonzero((s > self.over[:, None]) & (self.ids[:, None] != ids))
        query, id_, score = np.r_[self.query, q], np.r_[self.id, ids[i]], np.r_[self.score, s[q, i]]
        keep = vectors.best(query, score, id_, self.k)
        self.query, self.id, self.score = query[keep], id_[keep], score[keep]
        full = np.bincount(self.query, minlength=len(self.ids)) >= self.k
        last = np.zeros(len(self.ids), np.int64)
        last[self.query] = self.score  # in order of score: the last of a query is its lowest
        self.over = np.where(full, np.maximum(self.over, last), self.over)

    def out(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.id), pa.array(self.score)], ["query_id", "vec_id", "score"])
