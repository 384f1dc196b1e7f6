"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 3 or fewer differing bits share a value halfway: every fingerprint emits the values around it, the
values are shuffled, and fingerprints that meet are verified. Which values are emitted:

* distance 2 is between equal parities: both emit their 64 values at distance 1;
* distances 1 and 3 are between an even and an odd number of set bits: the odd one emits distance 1, the even one itself
  and those at distance 2 whose two flipped bits lie in the same half, as of any three bits two lie in the same half.

So an even fingerprint emits 1,057 values, an odd one 64, and no value can be emitted by more than 2,081 fingerprints:
groups are bounded whatever the data. Of those that meet, all are linked to one, not to each other; the links keep every
component of the whole graph.

Nulls and empty texts have no words and fingerprint 0; rows with equal doc_id are separate documents; a null doc_id
takes part but is never a component's id (null only if all ids of it are null); extra columns are ignored, but for
``keep_one``, which returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import components
from .common import cut, fresh, lookup, map_rows, tasks

BITS = 64
#: Values that a bucket should hold, for a few hundred MB in a worker.
BUCKET_VALUES = 1_500_000


def fingerprint(text: str | None, words: int = 3) -> int:
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = len(w) - words + 1
    if n < 1:
        shingles, n = [b" ".join(w)], 1
    elif words == 3:
        shingles = map(b"%b %b %b".__mod__, zip(w, w[1:], w[2:], strict=False))
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long; with ``row``, that column (a long) too."""

    def make():
        def f(cols):
            yield [cols[0], np.array([fingerprint(t, words) for t in cols[1]], np.uint64).view(np.int64), *cols[2:]]

        return f

    return map_rows(docs, ["doc_id", "text", *([row] if row else [])], "doc_id long, fp long" + ", row long" * bool(row), make)


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """Flip masks by code, and how many bits each flips: code 0 none, 1 to 64 one bit, then pairs within a half."""
    one = [1 << i for i in range(BITS)]
    two = [1 << i | 1 << j for j in range(BITS) for i in range(j) if i // 32 == j // 32]
    return np.array([0, *one, *two], np.uint64), np.array([0] + [1] * len(one) + [2] * len(two), np.int8)


MASKS, FLIPS = _masks()
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _emit(buckets: int):
    """Rows (bucket, fps, how many values of each, codes of the values), packed."""

    def f(cols) -> Iterator[list]:
        fps = np.array(cols[0], np.int64).view(np.uint64)
        odd = np.bitwise_count(fps).astype(bool) & (np.bitwise_count(fps) % 2 == 1)
        for own, codes in ((fps[~odd], np.arange(len(MASKS), dtype=np.uint16)), (fps[odd], np.arange(1, BITS + 1, dtype=np.uint16))):
            step = max(1, 2_000_000 // len(codes))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                values = part[:, None] ^ MASKS[codes][None, :]
                bucket = (((values * _SPREAD) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32).ravel()
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                who, code = (order // len(codes)).astype(np.uint32), codes[order % len(codes)]
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                out = [[], [], [], []]
                for a, b in zip(starts, np.r_[starts[1:], len(bucket)], strict=True):
                    w = who[a:b]
                    new = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                    for col, x in zip(out, (int(bucket[a]), part[w[new]].tobytes(), np.diff(np.r_[new, b - a]).astype(np.uint16).tobytes(), code[a:b].tobytes()), strict=True):
                        col.append(x)
                yield out

    return f


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what a[i]-b[i] connect."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (hop := new[new]).tobytes() != new.tobytes():
            new = hop
        new = new[label]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def meet(fps: np.ndarray, codes: np.ndarray, distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the fingerprints whose emitted values are equal."""
    values = fps ^ MASKS[codes]
    order = np.argsort(values)
    values, fps, flips = values[order], fps[order], FLIPS[codes[order]]
    new = np.r_[True, values[1:] != values[:-1]]
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    values, fps, flips, run = values[many], fps[many], flips[many], run[many]
    if not len(run):
        return fps, fps
    # all members of a group are within reach of one that is a single flip away
    order = np.lexsort((fps, flips != 1, run))
    fps, flips, run = fps[order], flips[order], run[order]
    first = np.r_[True, run[1:] != run[:-1]]
    at = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
    a, b = fps[at], fps
    ok = (flips[at] == 1) & (a != b) & (np.bitwise_count(a ^ b) <= distance)
    return a[ok], b[ok]


def _receive():
    """Over rows sorted by bucket: a forest of each bucket's links."""

    class Buckets:
        def __init__(self):
            self.bucket, self.parts = None, []

        def close(self):
            if self.parts:
                fps = np.concatenate([np.repeat(np.frombuffer(f, np.uint64), np.frombuffer(n, np.uint16)) for f, n, _ in self.parts])
                a, b = meet(fps, np.concatenate([np.frombuffer(c, np.uint16) for _, _, c in self.parts]))
                self.parts = []
                if len(a):
                    a, b = _forest(a, b)
                    yield [a.view(np.int64), b.view(np.int64)]

        def __call__(self, cols):
            for bucket, *part in zip(*cols, strict=True):
                if bucket != self.bucket:
                    yield from self.close()
                    self.bucket = bucket
                self.parts.append(part)

        def finish(self):
            yield from self.close()

    return Buckets()


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, which have the components of all pairs at 3 or fewer bits."""
    spark = fps.sparkSession
    n = fps.count()
    buckets = tasks(spark, n * 560, BUCKET_VALUES)
    # few fingerprints make many values: dealt so that each task makes as many as a bucket holds
    rows = map_rows(fps.select("fp").repartition(buckets), ["fp"], "bucket int, fps binary, n binary, codes binary", lambda: _emit(buckets))
    dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return map_rows(dealt, ["bucket", "fps", "n", "codes"], "a long, b long", _receive).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of ``docs``; with ``row``, that column (a long) as ``row``, and
    ``class``, which names the component also where doc_ids repeat or are null."""
    found = cut(fingerprints(docs, words, row))
    per = cut(found.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    total = found.count()
    roots = components(links(per.select("fp")))
    class_of = per.join(roots, per.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("class"))
    class_of = cut(class_of)
    classes = cut(class_of.groupBy("class").agg(F.min("low").alias("component_id"), F.count("*").alias("m")))
    ids = cut(lookup(class_of, classes, ["class"], "m", per.count(), ["fp"]).select("fp", "n", "component_id", "class"))
    own = ["row"] * bool(row)
    out = lookup(found, ids, ["fp"], "n", total, ["doc_id", *own])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *own, *["class"] * bool(row))


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with one row of each component: of the smallest doc_id, of rows that share it the first by a hash of the
    row. Rows without doc_id go if their component has one; a component without any keeps all its rows.

    What stays is decided on (doc_id, hash of the row) alone; whole rows are shuffled once, to meet the decision."""
    row, same, n = (fresh(docs, x) for x in ("row", "same", "n"))
    marked = docs.withColumn(row, F.xxhash64(*docs.columns))
    groups = cut(near_duplicates(marked, words, row))
    total = groups.count()
    per = groups.filter("doc_id = component_id").groupBy("class", "doc_id", "row").agg(F.count("*").alias("same"))
    chosen = per.groupBy("class").agg(F.min(F.struct("row", "doc_id", "same")).alias("x"))
    chosen = cut(chosen.select("x.doc_id", F.col("x.row").alias(row), F.col("x.same").alias(same)))
    alone = cut(groups.filter("doc_id IS NULL AND component_id IS NULL").groupBy(F.col("row").alias(row)).agg(F.count("*").alias(n)))
    rows = lookup(marked.filter("doc_id IS NOT NULL"), chosen, ["doc_id", row], same, total, [row])
    # only rows that are alike in all columns need another look
    single = rows.filter(F.col(same) == 1).select(*docs.columns)
    alike = rows.filter(F.col(same) > 1).dropDuplicates(["doc_id", row]).select(*docs.columns)
    nameless = lookup(marked.filter("doc_id IS NULL"), alone, [row], n, total, [row]).filter(F.col(n).isNotNull()).select(*docs.columns)
    return single.unionByName(alike).unionByName(nameless)
