"""Line dedup with sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of ASCII white space and A-Z lower-cased. Keys of at least ``min_chars`` code points
held by at least ``min_docs`` documents lose all their lines but those of the largest doc_id holding them.

State (``LineIndex``): which documents hold which key (``postings``), references and keeper of each key (``refs``), and a
cuckoo filter of the common keys for each shard of the key space (``filters``). Inserting and deleting documents touches
the keys of these documents and the filters of their shards only: what is touched is looked up in the tables, a scan where
the change is small, and put in place of the old rows; every ``FOLD`` changes the tables are written anew. A filter that
would be fuller than ``FULL`` is built anew, twice as large, from the exact table. Nothing is lost, so a deletion undoes an
insertion.

Nulls and empty texts are one empty line. Rows with the same doc_id count as one document and lose the same lines. Rows
with null doc_id count for nothing and lose nothing. Extra columns pass through ``clean``, but for n_lines and
n_dropped, which are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from .common import HOT_SHARE, cut, fresh, lookup, map_rows, tasks

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys in a shard, about: a filter and its exact table are then a few MB.
SHARD_KEYS = 50_000
#: Lines looked up in a shard, about: so few that tasks can share them evenly.
SHARD_LINES = 500
#: The share of its slots that a filter fills.
FULL = 0.85
#: Changes after which the tables are written anew.
FOLD = 8


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, partial-key displacement; what finds no place goes to an exact stash."""

    SLOTS, KICKS = 4, 200

    def __init__(self, keys: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(2, keys / self.SLOTS / FULL)))))
        self.table = np.zeros((self.buckets, self.SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        fp = (h2.view(np.uint64) % np.uint64(65535)).astype(np.int64) + 1
        one = (h1.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (self.buckets - 1)
        return fp, one, one ^ self._hop(fp)

    def _hop(self, fp):
        return (fp * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(h1, h2)
        found = (self.table[one] == fp[:, None]).any(1) | (self.table[two] == fp[:, None]).any(1)
        for at, x in self.stash:
            found |= (fp == x) & ((one == at) | (two == at))
        return found

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        rng = np.random.default_rng(7)
        for fp, one, two in zip(*(x.tolist() for x in self._places(h1, h2)), strict=True):
            for at in (one, two):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = fp
                    break
            else:
                at = two
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    fp, self.table[at, slot] = int(self.table[at, slot]), fp
                    at ^= int(self._hop(fp))
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = fp
                        break
                else:
                    self.stash.append((at, fp))

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Of keys that were inserted."""
        for fp, one, two in zip(*(x.tolist() for x in self._places(h1, h2)), strict=True):
            for at in (one, two):
                if (at, fp) in self.stash:
                    self.stash.remove((at, fp))
                    break
                own = np.flatnonzero(self.table[at] == fp)
                if len(own):
                    self.table[at, own[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return np.array([self.buckets, len(self.stash), *(v for x in self.stash for v in x)], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.buckets, n = np.frombuffer(data, np.int64, 2).tolist()
        flat = np.frombuffer(data, np.int64, 2 * n, 16).tolist()
        out.stash = list(zip(flat[::2], flat[1::2], strict=True))
        out.table = np.frombuffer(data, np.uint16, offset=16 + 16 * n).reshape(out.buckets, cls.SLOTS).copy()
        return out


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame  # h1, h2, doc_id
    refs: DataFrame  # h1, h2, refs, keeper
    filters: DataFrame  # shard, filter, slots
    shards: int
    min_chars: int
    min_docs: int
    changes: int = 0


def line_keys(text: str | None) -> list[bytes]:
    return [x.strip().lower() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _chars(key: bytes) -> int:
    return len(key) if key.isascii() else len(key) - sum(1 for b in key if b & 0xC0 == 0x80)


def _digest(key: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(key)
    return (d >> 64) - (1 << 63), (d & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    def make():
        def f(cols):
            out = [[], [], []]
            for doc, text in zip(*cols, strict=True):
                if doc is None:
                    continue
                for a, b in {_digest(k) for k in set(line_keys(text)) if len(k) >= min_chars and _chars(k) >= min_chars}:
                    out[0].append(a)
                    out[1].append(b)
                    out[2].append(doc)
            yield out

        return f

    return map_rows(docs, ["doc_id", "text"], "h1 long, h2 long, doc_id long", make)


def _refs(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("keeper"))


def _shard(shards: int):
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")


FILTERS = "shard int, filter binary, slots long"


def _new_filters(keys: DataFrame, shards: int) -> DataFrame:
    """Filters with room for twice the keys (h1, h2)."""

    def make():
        class Shards:
            shard, parts = None, []

            def close(self):
                if self.parts:
                    h1, h2 = np.concatenate(self.parts, axis=1)
                    f = CuckooFilter(2 * len(h1))
                    f.insert(h1, h2)
                    self.parts = []
                    yield [[self.shard], [f.to_bytes()], [f.table.size]]

            def __call__(self, cols):
                shard, h1, h2 = (np.array(x, np.int64) for x in cols)
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
                    if shard[a] != self.shard:
                        yield from self.close()
                        self.shard = int(shard[a])
                    self.parts = [*self.parts, np.stack([h1[a:z], h2[a:z]])]

            def finish(self):
                yield from self.close()

        return Shards()

    n = tasks(keys.sparkSession, shards, 2000)
    dealt = keys.select(_shard(shards), "h1", "h2").repartition(n, "shard").sortWithinPartitions("shard", "h1", "h2")
    return map_rows(dealt, ["shard", "h1", "h2"], FILTERS, make)


def _changed_filters(changes: DataFrame, filters: DataFrame) -> DataFrame:
    """The filters of shards with changes (shard, h1, h2, add: true if the key became common, false if it no longer is)."""

    def change(key, keys, old):
        import pandas as pd

        f = CuckooFilter.from_bytes(old["filter"].iloc[0])
        add, drop = (keys[keys["add"] == x] for x in (True, False))
        f.delete(drop.h1.to_numpy(), drop.h2.to_numpy())
        f.insert(add.h1.to_numpy(), add.h2.to_numpy())
        return pd.DataFrame({"shard": [key[0]], "filter": [f.to_bytes()], "slots": [f.table.size]})

    return changes.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(change, FILTERS)


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    postings = cut(_postings(docs, min_chars).distinct())
    refs = cut(_refs(postings))
    common = refs.filter(F.col("refs") >= min_docs)
    # enough shards that neither their keys nor the lines looked up in one are many
    shards = max(8, -(-common.count() // SHARD_KEYS), -(-postings.count() // SHARD_LINES))
    return LineIndex(postings, refs, cut(_new_filters(common, shards)), shards, min_chars, min_docs)


def _moved(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index with other postings, of which the keys ``touched`` (h1, h2) have changed."""
    keys = ["h1", "h2"]
    touched = cut(touched.select(*keys).distinct())
    few = small(touched)
    old = cut(index.refs.join(few, keys, "left_semi"))
    new = cut(_refs(postings.join(few, keys, "left_semi")))
    refs = index.refs.join(few, keys, "left_anti").unionByName(new)
    is_common = lambda df: df.filter(F.col("refs") >= index.min_docs).select(*keys)
    crossed = is_common(new).join(is_common(old), keys, "left_anti").withColumn("add", F.lit(True)).unionByName(is_common(old).join(is_common(new), keys, "left_anti").withColumn("add", F.lit(False)))
    crossed = cut(crossed.select(_shard(index.shards), *keys, "add"))
    # what each changed shard will hold, against the room that its filter has
    shards = cut(crossed.groupBy("shard").agg(F.count_if("add").alias("more")))
    held = is_common(refs).select(_shard(index.shards)).join(small(shards), "shard", "left_semi").groupBy("shard").agg(F.count("*").alias("held"))
    room = shards.join(held, "shard", "left").join(index.filters.select("shard", "slots"), "shard", "left")
    full = F.col("slots").isNull() | (F.coalesce("held", F.lit(0)) > F.floor(FULL * F.col("slots")))
    room = cut(room.select("shard", full.alias("full")))
    grown = is_common(refs).withColumn("shard", _shard(index.shards)).join(small(room.filter("full")), "shard", "left_semi")
    same = small(room.filter("not full"))
    changed = _changed_filters(crossed.join(same, "shard", "left_semi"), index.filters.join(same, "shard", "left_semi"))
    filters = cut(index.filters.join(small(shards), "shard", "left_anti").unionByName(changed).unionByName(_new_filters(grown, index.shards)))
    n = index.changes + 1
    fold = cut if n % FOLD == 0 else lambda df: df
    return replace(index, postings=fold(postings), refs=fold(refs), filters=filters, changes=n)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    own = cut(_postings(docs, index.min_chars).distinct())
    there = index.postings.join(small(own.select("doc_id").distinct()), "doc_id", "left_semi")
    new = cut(own.join(there, ["h1", "h2", "doc_id"], "left_anti"))
    return _moved(index, index.postings.unionByName(new), new)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """doc_ids: the column doc_id."""
    ids = small(cut(doc_ids.select("doc_id").distinct()))
    gone = index.postings.join(ids, "doc_id", "left_semi")
    return _moved(index, index.postings.join(ids, "doc_id", "left_anti").select("h1", "h2", "doc_id"), gone)


def _probe():
    """Over rows sorted by (shard, kind): the shard's filter, its exact table, then the lines to look up."""

    class Shards:
        shard, filter, rows, table = None, None, None, None

        def __call__(self, cols):
            shard, kind = np.array(cols[0], np.int64), np.array(cols[1], np.int64)
            h1, h2, doc = (np.array(x, np.int64) for x in cols[2:5])
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
                if shard[a] != self.shard:
                    self.shard, self.filter, self.rows, self.table = shard[a], None, [], None
                if kind[a] == 0:
                    self.filter = CuckooFilter.from_bytes(cols[5][a])
                elif kind[a] == 1:
                    self.rows.append(np.stack([h1[a:b], h2[a:b], doc[a:b]]))
                elif self.filter is not None:
                    if self.table is None:
                        # deletions may have left a filter without keys
                        all_rows = np.concatenate([np.zeros((3, 0), np.int64), *self.rows], axis=1)
                        self.table = all_rows[:, np.lexsort((all_rows[1], all_rows[0]))]
                    maybe = a + np.flatnonzero(self.filter.contains(h1[a:b], h2[a:b]))
                    yield self.exact(h1[maybe], h2[maybe], doc[maybe])

        def exact(self, h1, h2, doc):
            keys = self.table
            at = np.searchsorted(keys[0], h1)
            found = np.zeros(len(h1), bool)
            keeper = doc.copy()
            open_ = np.flatnonzero(at < keys.shape[1])
            while len(open_):  # keys that share h1 stand side by side
                same = keys[0][at[open_]] == h1[open_]
                open_ = open_[same]
                hit = keys[1][at[open_]] == h2[open_]
                found[open_[hit]] = True
                keeper[open_[hit]] = keys[2][at[open_[hit]]]
                open_ = open_[~hit]
                at[open_] += 1
                open_ = open_[at[open_] < keys.shape[1]]
            drop = found & (keeper != doc)
            return [h1[drop], h2[drop], doc[drop]]

    return Shards()


def drops(index: LineIndex, postings: DataFrame | None = None) -> DataFrame:
    """(h1, h2, doc_id): the keys that these documents lose."""
    rows = index.postings if postings is None else postings
    total = index.postings.count()
    common = index.refs.filter(F.col("refs") >= index.min_docs)
    limit = max(total // HOT_SHARE, 100)
    # keys with more than a thousandth of all lines, at most a thousand, are looked up where they stand
    hot = common.filter(F.col("refs") > limit).select("h1", "h2", F.col("keeper").alias("hot"))
    rows = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    shard, none = _shard(index.shards), F.lit(None).cast("binary").alias("blob")
    # found ones only pass through: they are dealt anywhere and have kind 3
    passing = F.when(F.col("hot").isNull(), F.pmod(F.col("h1"), F.lit(index.shards))).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))).cast("int").alias("shard")
    probes = rows.select(passing, F.when(F.col("hot").isNull(), 2).otherwise(3).alias("kind"), "h1", "h2", "doc_id", none).filter(F.col("hot").isNull() | (F.col("hot") != F.col("doc_id")))
    filters = index.filters.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("doc_id"), F.col("filter").alias("blob"))
    exact = common.select(shard, F.lit(1).alias("kind"), "h1", "h2", F.col("keeper").alias("doc_id"), none)
    n = max(tasks(rows.sparkSession, total, 500_000), 1)
    dealt = filters.union(exact).union(probes).repartition(n, "shard").sortWithinPartitions("shard", "kind")

    def make():
        shards = _probe()

        def f(cols):
            kind = np.array(cols[1], np.int64)
            own = np.flatnonzero(kind == 3)
            if len(own):
                yield [[c[i] for i in own] for c in cols[2:5]]
            rest = np.flatnonzero(kind != 3)
            if len(rest):
                yield from shards([[c[i] for i in rest] for c in cols])

        return f

    return map_rows(dealt, ["shard", "kind", "h1", "h2", "doc_id", "blob"], "h1 long, h2 long, doc_id long", make)


def clean(index: LineIndex, docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced, and n_lines, n_dropped; other columns as they were."""
    body, mark, n = fresh(docs, "line_text"), fresh(docs, "line_lost"), fresh(docs, "line_rows")
    lost = drops(index).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias(mark))
    per = cut(docs.groupBy("doc_id").agg(F.count("*").alias(n)))
    total = per.agg(F.sum(n)).first()[0] or 0
    # rows without doc_id lose nothing and go anywhere; an id of any number of rows is looked up where they stand
    rows = lookup(docs.withColumn(body, F.col("text")), cut(lost.join(per, "doc_id")), ["doc_id"], n, total, [body])
    n_chars = index.min_chars

    def make():
        def f(cols):
            out = [[], [], []]
            for text, lost in zip(cols[-2], cols[-1], strict=True):
                lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                kept = lines
                if lost:
                    gone = {(x["h1"], x["h2"]) for x in lost}
                    kept = [x for x in lines if len(x) < n_chars or _digest(x.strip().lower()) not in gone]
                out[0].append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                out[1].append(len(lines))
                out[2].append(len(lines) - len(kept))
            yield [*cols[:-2], *out]

        return f

    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + ["text string", "n_lines long", "n_dropped long"])
    return map_rows(rows, [*(f"`{c}`" for c in others), body, mark], schema, make)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return clean(build(docs, min_chars, min_docs), docs)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
