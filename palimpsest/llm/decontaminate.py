"""Benchmark decontamination with suffix arrays over the training text.

Each shard of documents (an Arrow batch of bounded bytes) is turned into word numbers and a suffix array. Every test suffix
is found in it by binary search for the range that shares its first window, and each place in that range is extended to the
longest verbatim match. So a match is (document, its word, item, its word, words); a suffix whose match is the rest of a
longer one, a word earlier on both sides, is left to that one. Hits, items and verdicts all come from these matches.

Suffixes of documents that cannot start a match, as some pair of their first words stands in no test item, are left out of
the array, which changes no result and keeps it small. Test items are searched in blocks of bounded size, each a file in the
shared folder that a task writes; a worker holds the blocks it used last, ``CACHE_BYTES`` of them.

Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. A window is ``size`` consecutive words of an
item; an item with fewer words is one window. A document word within any occurrence of a window is hit, and a document is
contaminated if at least ``share`` of its words are hit, and one at least.

Nulls and empty texts have no words: such items have no window, such documents are clean. Rows with equal ids are
separate documents, but count once as items. Item ids are compared as they are; null item ids are ignored. A text of any
length is judged whole. Without items every document is clean. Extra columns pass through ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, in_arrow, map_rows, scratch

SIZE = 13
#: A document with one word in so many hit is contaminated.
ONE_IN = 20
#: Bytes of test text in a block; as arrays it takes some ten times as much.
BLOCK_BYTES = 2 << 20
#: Bytes of blocks that a worker holds.
CACHE_BYTES = 96 << 20
#: Places that are extended at a time.
PAIRS = 1 << 20

#: Lower-cases A-Z, keeps 0-9, a-z and bytes beyond ASCII, makes all else a space.
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort as the rows do."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel() if len(rows) else np.zeros(0, f"S{max(1, rows.shape[1]) * 4}")


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of the next."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


class Tests:
    """Some test items as word numbers, laid end to end with a 0 after each, and their suffixes sorted by first window."""

    def __init__(self, items: list[tuple[int, str]], size: int = SIZE):
        self.size = size
        self.vocabulary: dict[bytes, int] = {}
        flat: list[int] = []
        ids, lengths = [], []
        for i, text in items:
            own = words(text)
            if i is not None and own:
                ids.append(i)
                lengths.append(len(own))
                flat += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
                flat.append(0)
        self.ids, n = np.array(ids, np.int64), np.array(lengths, np.int64)
        self.flat = np.array(flat, np.int64)
        self.starts = np.cumsum(n + 1) - n - 1
        # a suffix for each window, shorter items are one window
        length = np.minimum(n, size)
        per = n - length + 1
        at = spread(self.starts, per)
        wide = np.repeat(length, per)
        inside = np.arange(size)[None, :] < wide[:, None]
        rows = np.where(inside, self.flat[np.minimum(at[:, None] + np.arange(size)[None, :], max(0, len(flat) - 1))], 0) if len(at) else np.zeros((0, size), np.int64)
        low = keys(rows.astype(">u4"))
        order = np.argsort(low, kind="stable")
        self.at, low = at[order], low[order]
        #: Suffixes by window: those of window w are at[first[w] : first[w] + count[w]].
        self.first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
        self.count = np.diff(np.r_[self.first, len(low)])
        self.lengths = wide[order][self.first] if len(low) else np.zeros(0, np.int64)
        self.least = int(self.lengths.min()) if len(self.lengths) else 0
        self.low = low[self.first]
        top = np.where(inside, rows, 0xFFFFFFFF)[order][self.first] if len(low) else rows
        self.high = keys(top.astype(">u4"))
        both = (self.flat[:-1] > 0) & (self.flat[1:] > 0)
        self.pairs = np.unique(self.flat[:-1][both] << 32 | self.flat[1:][both])

    def bytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + 120 * len(self.vocabulary)


class Shard:
    """The suffix array of some documents, over the words that tests have; all other words are number 0."""

    def __init__(self, docs: list[list[bytes]], tests: Tests):
        get = tests.vocabulary.get
        lengths = np.array([len(x) for x in docs], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ids = ids = np.zeros(int((lengths + 1).sum()), np.int64)
        for a, own in zip(self.starts.tolist(), docs, strict=True):
            ids[a : a + len(own)] = [get(w, 0) for w in own]
        n, need = len(ids), tests.least
        ok = ids > 0
        if need > 1 and n:
            pair = np.zeros(n, bool)
            both = np.flatnonzero(ok[:-1] & ok[1:])
            code = ids[both] << 32 | ids[both + 1]
            at = np.minimum(np.searchsorted(tests.pairs, code), len(tests.pairs) - 1)
            pair[both[tests.pairs[at] == code]] = True
            # a suffix is kept if so many pairs in a row from its start are pairs of tests
            stops = np.r_[np.flatnonzero(~pair), n]
            run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
            ok = run >= need - 1
        places = np.flatnonzero(ok)
        ends = np.r_[np.flatnonzero(ids == 0), n]
        length = ends[np.searchsorted(ends, places)] - places
        step = np.arange(tests.size)
        rows = np.where(step[None, :] < length[:, None], ids[np.minimum(places[:, None] + step[None, :], max(0, n - 1))], 0).astype(">u4") if len(places) else np.zeros((0, tests.size), ">u4")
        k = keys(rows)
        order = np.argsort(k, kind="stable")
        self.places, self.keys = places[order], k[order]

    def matches(self, tests: Tests) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the shard, place in the tests, words) of longest matches, in parts of about ``PAIRS``."""
        lo, hi = np.searchsorted(self.keys, tests.low, "left"), np.searchsorted(self.keys, tests.high, "right")
        found = np.flatnonzero(hi > lo)
        here, there = (hi - lo)[found], tests.count[found]
        a = 0
        while a < len(found):
            # as many windows as fit; of one that doesn't fit alone, the suffixes in parts
            z = a + max(1, int(np.searchsorted(np.cumsum(here[a:] * there[a:]), PAIRS, "right")))
            step = max(1, PAIRS // int(here[a])) if z == a + 1 else int(there[a:z].max())
            for b in range(0, int(there[a:z].max()), step):
                w, n = found[a:z], np.minimum(step, there[a:z] - b)
                q = np.repeat(tests.at[spread(tests.first[w] + b, n)], np.repeat(here[a:z], n))
                p = self.places[spread(np.repeat(lo[w], n), np.repeat(here[a:z], n))]
                m = np.repeat(tests.lengths[w], n * here[a:z])
                # the rest of a match that starts a word earlier
                rest = (p > 0) & (q > 0) & (self.ids[p - 1] == tests.flat[q - 1]) & (tests.flat[q - 1] > 0)
                p, q, m = p[~rest], q[~rest], m[~rest]
                going = np.arange(len(p))
                while len(going):
                    own = self.ids[p[going] + m[going]]
                    going = going[(own > 0) & (own == tests.flat[q[going] + m[going]])]
                    m[going] += 1
                if len(p):
                    yield p, q, m
            a = z

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


_held: OrderedDict[str, Tests] = OrderedDict()


def _load(path: str) -> Tests:
    if path not in _held:
        fs, at = file_system(path)
        with fs.open_input_stream(at) as f:
            tests = pickle.loads(f.read())
        while _held and sum(x.bytes() for x in _held.values()) + tests.bytes() > CACHE_BYTES:
            _held.popitem(last=False)
        _held[path] = tests
    _held.move_to_end(path)
    return _held[path]


def prepare(items: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Writes the test items (item_id, text) in blocks, a task for each; the files' paths."""
    spark = items.sparkSession
    items = items.filter("item_id IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = scratch(spark, "tests")

    def make():
        class Block:
            rows: list = []

            def __call__(self, cols):
                self.rows = self.rows + list(zip(*cols, strict=True))
                return iter(())

            def finish(self):
                tests = Tests(self.rows, size)
                if len(tests.at):
                    # a name of its own for each attempt: those of the attempts that count are returned
                    path = f"{folder}/{uuid.uuid4().hex}"
                    fs, at = file_system(path)
                    with fs.open_output_stream(at) as f:
                        f.write(pickle.dumps(tests))
                    yield [[path]]

        return Block()

    dealt = items.repartition(max(1, -(-total // block_bytes)), "item_id", F.xxhash64("text"))
    return sorted(r.path for r in map_rows(dealt, ["item_id", "text"], "path string", make).collect())


def judge(texts: list[str | None], paths: list[str]) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """(words, hit words, ids of items with occurring windows) of each text."""
    part = [words(t) for t in texts]
    lengths = np.array([len(x) for x in part], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    edge = np.zeros(int((lengths + 1).sum()) + 1, np.int64)
    items: list[set] = [set() for _ in part]
    for path in paths:
        tests = _load(path)
        shard = Shard(part, tests)
        for p, q, m in shard.matches(tests):
            np.add.at(edge, p, 1)
            np.add.at(edge, p + m, -1)
            both = np.unique(shard.doc(p) << 32 | np.searchsorted(tests.starts, q, "right") - 1)
            for d, k in zip((both >> 32).tolist(), tests.ids[both & 0xFFFFFFFF].tolist(), strict=True):
                items[d].add(k)
    hit = np.cumsum(edge)[:-1] > 0
    return lengths, np.add.reduceat(hit, starts, dtype=np.int64) if len(part) else lengths, items


def is_contaminated(n_words: np.ndarray, n_hit: np.ndarray, one_in: int = ONE_IN) -> np.ndarray:
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def search(docs: DataFrame, paths: list[str], one_in: int = ONE_IN) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, item_ids (with occurring windows), contaminated."""
    schema = "doc_id long, n_words long, n_hit long, item_ids array<long>, contaminated boolean"

    def make():
        def f(cols):
            n_words, n_hit, items = judge(cols[1], paths)
            yield [cols[0], n_words, n_hit, [list(x) for x in items], is_contaminated(n_words, n_hit, one_in)]

        return f

    return map_rows(docs, ["doc_id", "text"], schema, make)


def longest_matches(docs: DataFrame, paths: list[str]) -> DataFrame:
    """(doc_id, doc_word, item_id, item_word, n_words): for every test suffix its longest match in each document, of equal
    ones the first."""

    def make():
        def f(cols):
            part = [words(t) for t in cols[1]]
            for path in paths:
                tests = _load(path)
                shard = Shard(part, tests)
                every = [np.zeros((3, 0), np.int64)]
                for p, q, m in shard.matches(tests):
                    # a match is one of each suffix that starts in it, as long as a window is left
                    k = np.searchsorted(tests.starts, q, "right") - 1
                    size = np.diff(np.r_[tests.starts, len(tests.flat)])[k] - 1
                    n = m - np.minimum(size, tests.size) + 1
                    by = spread(np.zeros(len(n), np.int64), n)
                    every.append(np.stack([np.repeat(x, n) for x in (p, q, m)]) + np.stack([by, by, -by]))
                p, q, m = np.concatenate(every, axis=1)
                d = shard.doc(p)
                order = np.lexsort((p, -m, q, d))
                p, q, m, d = p[order], q[order], m[order], d[order]
                best = np.r_[True, (d[1:] != d[:-1]) | (q[1:] != q[:-1])][: len(d)]
                p, q, m, d = p[best], q[best], m[best], d[best]
                k = np.searchsorted(tests.starts, q, "right") - 1
                yield [[cols[0][x] for x in d.tolist()], p - shard.starts[d], tests.ids[k], q - tests.starts[k], m]

        return f

    return map_rows(docs, ["doc_id", "text"], "doc_id long, doc_word long, item_id long, item_word long, n_words long", make)


def remove_contaminated(docs: DataFrame, paths: list[str], one_in: int = ONE_IN) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; every row is judged by its own text."""

    def run(batches):
        for batch in batches:
            n_words, n_hit, _ = judge(batch.column(batch.schema.get_field_index("text")).to_pylist(), paths)
            yield batch.filter(pa.array(~is_contaminated(n_words, n_hit, one_in)))

    return in_arrow(docs, run, docs.schema)


def joined_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
