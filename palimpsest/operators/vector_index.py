"""A stored index of vectors: inverted cells, searched by the nearest few, or exactly.

Centroids come from a bounded sample of the vectors (``SAMPLE``, by a hash of the id). Every vector is assigned to its nearest
centroid and stored with those of its cell, in files of their own, so a search reads only the cells that it probes. How many that
are is calibrated when the index is built: some sample vectors are looked up exactly, and the probes cover ``recall`` of what is
found for each of them. An exact search goes on from there: each cell has a radius, and by the triangle inequality only cells that
may hold something nearer than what was found are read too. Vectors can be appended: they join their cells' files.

Distances are cosine distances; null vectors and those without length are left out, vectors of another size refused."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import top_k
from .state import cut_round

#: Vectors that centroids are made of at most, cells at most, vectors that calibrate the probes, questions of a block about.
SAMPLE, CELLS, TRIALS, BLOCK = 20_000, 4096, 64, 1000
ROWS = "item_id long, embedding array<float>, cell int"


@dataclass(frozen=True)
class Index:
    """path/cells/cell=N: (item_id, embedding); path/reach: (cell, radius, n) of each write; centers: unit vectors."""

    spark: SparkSession
    path: str
    centers: np.ndarray
    probes: int

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """All vectors, or those of some cells, of which alone the files are read."""
        rows = self.spark.read.schema(ROWS).parquet(f"{self.path}/cells")
        return rows if cells is None else rows.filter(F.col("cell").isin(cells))

    def radii(self) -> np.ndarray:
        """The largest distance of a member to its centroid, by cell; -1 for an empty cell."""
        out = np.full(len(self.centers), -1.0)
        for c, r in self.spark.read.parquet(f"{self.path}/reach").groupBy("cell").agg(F.max("radius")).collect():
            out[c] = r
        return out


def _unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows have one) of a list column."""
    flat = column.fill_null([0.0] * size) if column.null_count else column
    lengths = np.diff(flat.offsets.to_numpy())
    if (lengths != size).any():
        raise ValueError(f"vectors of {size} components are asked for, not of {set(lengths.tolist()) - {size}}")
    v = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.float64)
    norm = np.sqrt((v * v).sum(1))
    return v / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _trained(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids: rounds of reassigning the sample, starting with its first rows."""
    centers = np.unique(sample, axis=0)
    centers = centers[np.random.default_rng(0).permutation(len(centers))[:cells]]
    for _ in range(rounds):
        own = (sample @ centers.T).argmax(1)
        for c in np.unique(own):
            mean = sample[own == c].mean(0)
            length = np.sqrt(mean @ mean)
            if length > 0:
                centers[c] = mean / length
    return centers


def build(vectors: DataFrame, path: str, cells: int = 0, k: int = 10, recall: float = 0.9) -> Index:
    """Writes the index of ``vectors`` (item_id, embedding) to ``path``. ``cells`` 0: about the root of their number."""
    spark = vectors.sparkSession
    rows = vectors.select("item_id", "embedding").filter("embedding IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    cells = min(cells or max(1, round(n**0.5)), CELLS)
    some = rows.orderBy(F.xxhash64("item_id"), "item_id").limit(min(SAMPLE, max(64 * cells, TRIALS))).collect() if n else []
    sample, has = _unit(pa.array([r.embedding for r in some], pa.list_(pa.float64())), size) if some else (np.zeros((0, size or 0)), np.zeros(0, bool))
    centers = _trained(sample[has], cells) if has.any() else np.zeros((0, size or 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").write.parquet(f"{path}/centers")
    first = Index(spark, path, centers, len(centers))
    append(first, vectors)
    probes = _calibrated(first, [(r.item_id, r.embedding) for r, h in zip(some, has, strict=True) if h][:TRIALS], k, recall)
    spark.createDataFrame([(probes,)], "probes int").write.parquet(f"{path}/probes")
    return Index(spark, path, centers, probes)


def load(spark: SparkSession, path: str) -> Index:
    """An index that was built before: centroids are as many as cells, so they fit the driver."""
    centers = np.array([r.center for r in spark.read.parquet(f"{path}/centers").orderBy("cell").collect()])
    return Index(spark, path, centers, spark.read.parquet(f"{path}/probes").first().probes)


def append(index: Index, vectors: DataFrame) -> None:
    """Adds ``vectors`` (item_id, embedding): they join their cells, and later searches find them."""
    if not len(index.centers):
        return
    centers = index.centers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, has = _unit(b.column(1), centers.shape[1])
            near = v @ centers.T
            cell = near.argmax(1)
            off = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(v)), cell], 0))
            keep = pa.array(has)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(off)], ["item_id", "embedding", "cell", "off"]).filter(keep)

    rows = cut_round(vectors.select("item_id", "embedding").filter("embedding IS NOT NULL").mapInArrow(place, f"{ROWS}, off double"))
    # a cell's rows lie together; a cell of any share of the rows is dealt to several tasks by the second column
    rows.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(8))).drop("off").write.mode("append").partitionBy("cell").parquet(f"{index.path}/cells")
    rows.groupBy("cell").agg(F.max("off").alias("radius"), F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{index.path}/reach")


def _calibrated(index: Index, trials: list, k: int, recall: float) -> int:
    """How many of a question's nearest cells hold ``recall`` of its ``k`` nearest vectors, for all of ``trials``."""
    if not trials:
        return len(index.centers)
    asked = index.spark.createDataFrame(trials, "question_id long, qvec array<float>")
    found = search(index, asked, k, probes=len(index.centers))
    at = {i: np.argsort(-(index.centers @ (np.array(v) / np.linalg.norm(v))), kind="stable").argsort() for i, v in trials}
    need: dict[int, list[int]] = {}
    for q, cell in found.join(index.vectors().select("item_id", "cell"), "item_id").select("question_id", "cell").collect():
        need.setdefault(q, []).append(int(at[q][cell]) + 1)
    # other questions may need some more than these
    most = max(sorted(x)[max(0, -(-int(1000 * recall * len(x)) // 1000) - 1)] for x in need.values())
    return min(len(index.centers), most + -(-most // 10) + 1)


def search(index: Index, questions: DataFrame, k: int, probes: int | None = None, gate: float = 2.0, exact: bool = False, recall: float = 0.0) -> DataFrame:
    """(question_id, item_id, distance, rank): of each question (question_id, qvec) the ``k`` nearest vectors of the cells that it
    probes, or of all if ``exact``. With ``recall``, cells are read on until that share of each question's nearest is certain, as
    probes that cover the trials may not cover every question. Questions without a vector, or one without length, have none."""
    sure = k if exact else min(k, -(-int(1000 * recall * k) // 1000))
    spark, schema = questions.sparkSession, "question_id long, item_id long, distance double"
    out, none = None, spark.createDataFrame([], schema)
    if not len(index.centers):
        return top_k(none, ["question_id"], ["item_id"], k)
    radii = index.radii() if sure else None
    for block in _blocks(index, questions):
        ids, q = block
        off = np.sqrt(np.maximum(2 - 2 * (q @ index.centers.T), 0))
        turn = off.argsort(1, kind="stable").argsort(1)
        first = turn < (probes or index.probes)
        one = _read(index, ids, q, first, k, gate, schema)
        if sure:
            one = cut_round(one)
            last = top_k(one, ["question_id"], [F.round("distance", 9), F.col("item_id")], sure).groupBy("question_id").agg(F.count("*").alias("n"), F.max("distance").alias("d")).collect()
            # chord of the last distance that is to be certain; what is farther than the gate doesn't count anyway
            bound = np.full(len(ids), np.sqrt(2 * gate) + 1e-6)
            place = {x: i for i, x in enumerate(ids.tolist())}
            for r in last:
                if r.n >= sure:
                    bound[place[r.question_id]] = np.sqrt(2 * max(r.d, 0)) + 1e-6
            rest = ~first & (radii >= 0) & (off - radii <= bound[:, None])
            one = one.unionByName(_read(index, ids, q, rest, k, gate, schema))
        out = one if out is None else out.unionByName(one)
    return top_k(none if out is None else out, ["question_id"], [F.round("distance", 9), F.col("item_id")], k)


def _blocks(index: Index, questions: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of about ``BLOCK`` questions at a time, those of the same cells together."""
    centers = index.centers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, has = _unit(b.column(1), centers.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((v @ centers.T).argmax(1).astype(np.int32))], ["question_id", "qvec", "cell"]).filter(pa.array(has))

    rows = cut_round(questions.select(F.col("question_id").cast("long").alias("question_id"), F.col("qvec").cast("array<float>").alias("qvec")).filter("qvec IS NOT NULL").mapInArrow(place, "question_id long, qvec array<float>, cell int"))
    counts = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}
    packs, filled = [], BLOCK
    for cell in sorted(counts, key=lambda c: tuple(-np.sort(-(centers @ centers[c]))[:2]) + (c,)):
        if counts[cell] > BLOCK:
            parts = -(-2 * counts[cell] // BLOCK)  # hashes fall unevenly
            packs += [F.col("cell").eqNullSafe(cell) & (F.pmod(F.xxhash64("question_id"), F.lit(parts)) == p) for p in range(parts)]
            filled = BLOCK
        elif filled + counts[cell] > BLOCK:
            packs.append(F.col("cell") == cell)
            filled = counts[cell]
        else:
            packs[-1] = packs[-1] | (F.col("cell") == cell)
            filled += counts[cell]
    for some in packs:
        got = rows.filter(some).select("question_id", "qvec").toArrow().combine_chunks()
        if got.num_rows:
            yield got.column(0).to_numpy(), _unit(got.column(1).combine_chunks() if isinstance(got.column(1), pa.ChunkedArray) else got.column(1), centers.shape[1])[0]


def _read(index: Index, ids: np.ndarray, q: np.ndarray, probed: np.ndarray, k: int, gate: float, schema: str) -> DataFrame:
    """Of a block of questions the ``k`` best of each task, over the cells that a question of the block probes."""
    cells = np.flatnonzero(probed.any(0)).tolist()
    if not cells:
        return index.spark.createDataFrame([], schema)
    size = q.shape[1]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, item, dist = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for b in batches:
            cell = b.column(2).to_numpy()
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for o in range(0, len(rows), 4096):
                    r = rows[o : o + 4096]
                    v, _ = _unit(b.column(1).take(pa.array(r)), size)
                    own = np.flatnonzero(probed[:, c])
                    d = 1 - q[own] @ v.T
                    i, j = np.nonzero(d <= gate)
                    who, item, dist = np.r_[who, own[i]], np.r_[item, b.column(0).to_numpy()[r[j]]], np.r_[dist, d[i, j]]
                    # the task's best so far
                    order = np.lexsort((item, np.round(dist, 9), who))
                    w = who[order]
                    start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, int)
                    rank = np.arange(len(w)) - np.repeat(start, np.diff(np.r_[start, len(w)]))
                    order = order[rank < k]
                    who, item, dist = who[order], item[order], dist[order]
        yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(item), pa.array(dist)], ["question_id", "item_id", "distance"])

    return index.vectors(cells).mapInArrow(compare, schema)
