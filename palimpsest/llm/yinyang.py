"""Centroid clustering with Yinyang bounds.

Centroids are put into groups once. Each vector carries its cluster, an upper bound on the distance to its centroid and, for each
group, a lower bound on the distance to all other centroids of the group. When centroids move, the bounds move by as much, and a
vector is compared again only if they leave its cluster open: first the least bound of all groups is tried (global filter), then,
with the exact distance, each group's (group filter), and only the centroids of groups that are left are scanned, exactly. What
decides is whole numbers; bounds are widened by what floating point may lose, and equality never passes a filter, so ties go to the
smaller number as in a full scan.

A round is one job: it moves bounds, reassigns, and sends for each task and cluster what joined and left it, a sum and a count, so
centroids are kept up by differences. Its rows are a written table that the next round reads; of older ones the files are removed.
The driver holds the centroids alone. Vectors that are not whole, or have not ``size`` components, take no part; repeated rows are
rows; a null id is last among the hashes; fewer rows than centroids make as many centroids as rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import scratch
from . import vectors
from .common import in_arrow
from .vectors import SLACK, matrix

ROW = "vec_id long, v array<int>, cluster int, upper double, lower array<double>, distance long, moved int"


def starts(rows: DataFrame, k: int, seed: Column) -> np.ndarray:
    """The ``k`` rows (vec_id, v) whose ``seed`` text has the least SHA-256, in that order; of equal ones the smaller vector."""
    some = rows.select("v", F.sha2(seed.cast("binary"), 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in some], np.int64)


def grouped(centers: np.ndarray, groups: int) -> np.ndarray:
    """A group for each centroid: a few rounds of clustering of the centroids themselves."""
    groups = max(1, min(groups, len(centers)))
    at, c = centers[:groups].astype(np.float64), centers.astype(np.float64)
    for _ in range(5):
        own = ((c[:, None] - at) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                at[g] = c[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def squares(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances, as int64."""
    v2, c2 = (v.astype(np.int64) ** 2).sum(1), (centers.astype(np.int64) ** 2).sum(1)
    return v2[:, None] + c2 - 2 * vectors.dots(v, centers.astype(np.float64))


def _first(v: np.ndarray, centers: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, lower bounds by group) by a full scan."""
    d = squares(v, centers)
    own = d.argmin(1)
    rest, at = np.sqrt(d.astype(np.float64)), np.arange(len(v))
    rest[at, own] = np.inf
    lower = np.stack([rest[:, group == g].min(1, initial=np.inf) for g in range(group.max() + 1)], 1)
    return own, d[at, own], lower


def assign(v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centers: np.ndarray, group: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, number of distances computed) after the centroids moved by ``drift``, each its own way."""
    most = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    upper, lower = (upper + drift[own]) * (1 + SLACK), (lower - most) * (1 - SLACK) - SLACK
    own, least, seen = own.copy(), lower.min(1), 0
    todo = np.flatnonzero(upper >= least)  # global filter
    if not len(todo):
        return own, upper, lower, seen
    exact = ((v[todo].astype(np.int64) - centers[own[todo]]) ** 2).sum(1)
    upper[todo] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    seen += len(todo)
    still = upper[todo] >= least[todo]
    todo, exact = todo[still], exact[still]
    if not len(todo):
        return own, upper, lower, seen
    old, old_d = own[todo].copy(), exact.copy()
    best, best_d = old.copy(), exact.copy()
    open_ = lower[todo] <= upper[todo][:, None]  # group filter, by the distance to the centroid had so far
    first = np.full((len(todo), open_.shape[1]), np.inf)  # the nearest scanned centroid of each group
    second, nearest = first.copy(), np.full(open_.shape, -1)
    for g in range(open_.shape[1]):
        rows, members = np.flatnonzero(open_[:, g]), np.flatnonzero(group == g)
        if not len(rows):
            continue
        d = squares(v[todo[rows]], centers[members])
        seen += d.size
        for j, c in enumerate(members):
            r, dist = rows, np.sqrt(d[:, j].astype(np.float64))
            closer = dist < first[r, g]
            second[r, g] = np.where(closer, first[r, g], np.minimum(second[r, g], dist))
            nearest[r, g] = np.where(closer, c, nearest[r, g])
            first[r, g] = np.minimum(first[r, g], dist)
            wins = (d[:, j] < best_d[r]) | ((d[:, j] == best_d[r]) & (c < best[r]))
            best[r], best_d[r] = np.where(wins, c, best[r]), np.where(wins, d[:, j], best_d[r])
    # a scanned group's bound is its nearest centroid other than the winner
    scanned = np.where(nearest == best[:, None], second, first)
    lower[todo] = np.where(open_, scanned * (1 - SLACK), lower[todo])
    # the centroid left behind may be nearer than the bound of its group, if that was not scanned
    left = np.flatnonzero((best != old) & ~open_[np.arange(len(todo)), group[old]])
    at = todo[left], group[old[left]]
    lower[at] = np.minimum(lower[at], np.sqrt(old_d[left].astype(np.float64)) * (1 - SLACK))
    own[todo], upper[todo] = best, np.sqrt(best_d.astype(np.float64)) * (1 + SLACK)
    return own, upper, lower, seen


def _round(rows: DataFrame, centers: np.ndarray, group: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    """Rows after a round; the first one, without ``drift``, scans all. ``moved`` is the cluster that a row left, -1 for none."""
    size = centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(1), size)
            if drift is None:
                own, d, lower = _first(v, centers, group)
                moved, upper = np.full(len(v), -1), np.sqrt(d.astype(np.float64)) * (1 + SLACK)
            else:
                was, lower = b.column(2).to_numpy(), b.column(4).flatten().to_numpy().reshape(len(v), -1)
                own, upper, lower, _ = assign(v, was, b.column(3).to_numpy(), lower, centers, group, drift)
                moved = np.where(own != was, was, -1)
            d = ((v.astype(np.int64) - centers[own]) ** 2).sum(1) if last else np.zeros(len(v), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * lower.shape[1]), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(upper), lists, pa.array(d), pa.array(moved.astype(np.int32))], ["vec_id", "v", "cluster", "upper", "lower", "distance", "moved"])

    return in_arrow(rows.select(*[x.split()[0] for x in ROW.split(", ")[: 2 if drift is None else 5]]), run, ROW)


def _gained(rows: DataFrame, centers: np.ndarray, all_: bool) -> tuple[np.ndarray, np.ndarray]:
    """By how much the sums and counts of the clusters changed in a round: one row for each task and cluster that changed."""
    k, size = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            v, own, moved = matrix(b.column(0), size).astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy()
            for c in range(k):
                sums[c] += v[own == c].sum(0) - v[moved == c].sum(0)
            counts += np.bincount(own, minlength=k) - np.bincount(moved[moved >= 0], minlength=k)
        some = np.flatnonzero(sums.any(1) | (counts != 0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    moves = rows if all_ else rows.filter("moved >= 0")
    each = in_arrow(moves.select("v", "cluster", "moved"), run, "cluster int, n long, s array<long>")
    sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
    for c, j, s, n in each.select("cluster", "n", F.posexplode("s").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("x"), F.sum("n")).collect():
        sums[c, j], counts[c] = s, n
    return sums, counts


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, groups: int = 2, scale: int = 1024, size: int = 64, seed: int = 3, id_: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, cluster, distance) of every vector of ``size`` components, its squared distance, the centroids)."""
    spark = df.sparkSession
    own = F.col(f"`{id_}`").cast("long")
    rows = df.select(own.alias("vec_id"), vectors.whole(f"`{vector}`", scale, size).alias("v")).filter("v IS NOT NULL")
    centers = starts(rows, k, F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")))
    if not len(centers):
        return spark.createDataFrame([], "vec_id long, v array<int>, cluster int, distance long"), np.zeros((0, size), np.int64)
    group, at = grouped(centers, groups), scratch(spark, "yinyang")
    drift, sums, counts = None, np.zeros(centers.shape, np.int64), np.zeros(len(centers), np.int64)
    for r in range(rounds + 1):
        path = f"{at}/{r}"
        _round(rows, centers, group, drift, r == rounds).write.parquet(path)
        rows = spark.read.schema(ROW).parquet(path)
        if r:
            _remove(spark, f"{at}/{r - 1}")
        if r == rounds:
            break
        s, n = _gained(rows, centers, r == 0)
        sums, counts = sums + s, counts + n
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centers)
        drift = np.sqrt(((moved - centers) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        centers = moved
    return rows.select("vec_id", "v", "cluster", "distance"), centers


def report(found: DataFrame, centers: np.ndarray) -> DataFrame:
    """``found`` with each cluster's and the whole inertia, and the hash of its centroid: a row for each centroid is broadcast."""
    spark = found.sparkSession
    inertia = {c: s for c, s in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()
    of = spark.createDataFrame([(c, s, sum(inertia.values()), digest(c)) for c, s in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
