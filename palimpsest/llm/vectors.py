"""What the vector operators share: whole-number vectors, their matrices, augmented distances, best rows of a query.

Inner products become distances by one more component: with M2 the largest squared length of all vectors, a vector v gets
sqrt(M2 - |v|^2) and a query q gets 0, so that |q - v|^2 = |q|^2 + M2 - 2 q.v: the nearest vector is the one of highest score.
Scores are whole numbers and exact; distances only bound them, and every bound is widened by ``SLACK``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Components of this size and above, once scaled, have no place: their products would not fit a long.
MOST = 1 << 27
#: Share by which a bound on a distance is widened for what floating point loses.
SLACK = 1e-9


def whole(vector: str, scale: int, size: int | None = None) -> Column:
    """``vector`` as array<int> of floor(scale * x), x as double; null where it is null, holds a null, a NaN or an infinity or a
    component beyond ``MOST``, or has not ``size`` components."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < MOST, F.lit(False)))
    fits = F.coalesce(fits, F.lit(False)) & (F.lit(True) if size is None else F.size(vector) == size)
    return F.when(fits, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def prepared(df: DataFrame, scale: int, id_: str = "vec_id", vector: str = "embedding", extra: list[Column] | None = None) -> DataFrame:
    """(id, v, *extra) of the rows that take part: with an id and a vector that is whole. Rows that repeat an id count as one, the
    one of the smallest vector, then of the smallest ``extra``. Only ids are shuffled to find these."""
    rows = df.select(F.col(f"`{id_}`").cast("long").alias("id"), whole(f"`{vector}`", scale).alias("v"), *(extra or [])).filter("id IS NOT NULL AND v IS NOT NULL")
    rest = [c for c in rows.columns if c != "id"]
    twice = cut(rows.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select("id"))
    if not twice.limit(1).count():
        return rows
    one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*rest)).alias("_x")).select("id", *[F.col("_x")[c].alias(c) for c in rest])
    return rows.join(twice, "id", "left_anti").unionByName(one)


@dataclass(frozen=True)
class Space:
    """The vectors' number of components (of the longest; shorter ones end in zeros), largest squared length, and pivots: a
    bounded sample of the rows, by a hash of the id. ``pivots`` is a matrix, ``ids`` are their rows' ids."""

    size: int
    m2: float
    rows: int
    ids: np.ndarray
    pivots: np.ndarray

    def beside(self, vectors: np.ndarray) -> np.ndarray:
        """The further component of each vector of the data."""
        return np.sqrt(np.maximum(self.m2 - (vectors * vectors).sum(1), 0.0))

    def from_data(self, vectors: np.ndarray) -> np.ndarray:
        """Distance of each vector to each pivot, as rows of the data."""
        v2, p2 = (vectors * vectors).sum(1), (self.pivots * self.pivots).sum(1)
        flat = v2[:, None] + p2 - 2 * (vectors @ self.pivots.T)
        return np.sqrt(np.maximum(flat + (self.beside(vectors)[:, None] - self.beside(self.pivots)) ** 2, 0.0))

    def from_queries(self, queries: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
        """Distance of each query to each pivot, or to what has these scores."""
        scores = queries @ self.pivots.T if scores is None else scores
        return np.sqrt(np.maximum((queries * queries).sum(1)[:, None] + self.m2 - 2.0 * scores, 0.0))


def space(rows: DataFrame, pivots: int, most: int) -> Space:
    """The space of ``rows`` (id, v). ``pivots`` 0: about the root of the number of rows, 32 at least, ``most`` at most."""
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    size, m2, n = rows.agg(F.max(F.size("v")), F.max(norm), F.count("*")).first()
    size, m2 = size or 0, float(m2 or 0)
    take = min(pivots or max(32, int(n**0.5)), most)
    some = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(take).collect()
    found = np.zeros((len(some), size))
    for i, r in enumerate(some):
        found[i, : len(r.v)] = r.v
    return Space(size, m2, n, np.array([r.id for r in some], np.int64), found)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column as float64, with zeros behind the shorter ones."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (lengths == size).all():
        return flat.reshape(len(column), size).astype(np.float64)
    out = np.zeros((len(column), size))
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def packed(vectors: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in vectors.astype("<i4")]


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a binary column of ``packed`` vectors, all of ``size``."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, size).astype(np.float64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact, as int64. Doubles hold whole numbers up to 2^53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * np.abs(a).max() * np.abs(b).max() < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    at = np.arange(len(q))
    return order[at - np.maximum.accumulate(np.where(start, at, 0)) < k] if len(q) else order


__all__ = ["MOST", "SLACK", "Space", "best", "cut", "dots", "fresh", "matrix", "packed", "prepared", "space", "unpacked", "whole"]
