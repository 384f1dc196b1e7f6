"""Token ids in files of patched frame-of-reference blocks.

A block holds 128 ids: its minimum is subtracted, the rest is packed at the width that fits ``PERCENTILE`` % of it, and
larger values are exceptions (block, position, value). Up to 8,192 blocks form a group:

    ids, blocks, exceptions, bytes   4 x u32
    minimum u32, width u8, start u32 of each block; block u16, position u8, value u32 of each exception; packed bits

A file is a magic number, groups, then a footer: doc_id i64, null u8, ids u64 of each document; offset u64, first id u64
of each group; their numbers and the footer's offset (3 x u64), the magic number. So any range of ids can be read alone.

Documents are ordered by doc_id, nulls first, then by a hash of their text; repeated rows all are written. Nulls are empty
texts: just the end id. A file is one partition of that order, and no row is collected anywhere: only each file's number
of ids goes to the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.state import cut_round
from .common import file_system, map_rows, scratch, tasks

BLOCK, GROUP, PERCENTILE = 128, 8192, 90
MAGIC = b"PFORIDS1"
#: Documents per file, about.
FILE_DOCS = 20_000
#: Files whose ids are summed at a time.
RUN = 1000
#: Parts of text and pieces that a worker remembers: between once and twice as many, the latest.
REMEMBERED = 250_000
END_ID = 2

# Lower-case Latin parts: no white space but what cuts, no control characters, no ²³¹¼½¾, nothing from U+0250. All such
# code points beyond ASCII from U+00C0 but × and ÷ are letters.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_UNSAFE = re.compile("[^!-~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_STOPS = frozenset(".,;:!?")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


def pack(ids: np.ndarray) -> bytes:
    """One group of at most BLOCK * GROUP ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    rows = full.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = rows - low[:, None]
    # a number's bits are the exponent that frexp gives
    rank = min(BLOCK - 1, -(-BLOCK * PERCENTILE // 100) - 1)
    width = np.frexp(np.partition(rest, rank, axis=1)[:, rank].astype(np.float64))[1].astype(np.uint8)
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    for w in np.unique(width).tolist():
        if not w:
            continue
        own = np.flatnonzero(width == w)
        values = rest[own] & np.uint32((1 << w) - 1)
        bits = ((values[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        data[start[own][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
    block, place = np.nonzero(rest >> width[:, None].astype(np.uint32))
    head = np.array([n, blocks, len(block), len(data)], np.uint32)
    parts = (head, low, width, start.astype(np.uint32), block.astype(np.uint16), place.astype(np.uint8), rest[block, place], data)
    return b"".join(x.tobytes() for x in parts)


def unpack(raw: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a group, or of its blocks from ``first`` up to ``last``."""
    n, blocks, outliers, _ = np.frombuffer(raw, np.uint32, 4).tolist()
    at = 16

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    low, width, start = take(np.uint32, blocks), take(np.uint8, blocks), take(np.uint32, blocks)
    block, place, value = take(np.uint16, outliers), take(np.uint8, outliers), take(np.uint32, outliers)
    data = np.frombuffer(raw, np.uint8, offset=at)
    last = blocks if last is None else min(last, blocks)
    rest = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[first:last]).tolist():
        if not w:
            continue
        own = np.flatnonzero(width[first:last] == w)
        bits = np.unpackbits(data[start[first:last][own].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)], axis=1, bitorder="little").reshape(len(own), BLOCK, w)
        values = np.zeros((len(own), BLOCK), np.uint32)
        for k in range(w):
            values |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        rest[own] = values
    inside = (block >= first) & (block < last)
    rest[block[inside] - first, place[inside]] = value[inside]
    return (rest + low[first:last, None]).ravel()[: n - first * BLOCK]


class Writer:
    def __init__(self, path: str):
        fs, at = file_system(path)
        self.out = fs.open_output_stream(at)
        self.out.write(MAGIC)
        self.docs, self.nulls, self.sizes, self.offsets, self.firsts = [], [], [], [], []
        self.pending, self.waiting, self.n, self.at = [], 0, 0, len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids) // 4)
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= BLOCK * GROUP:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        end = len(ids) if last else len(ids) - len(ids) % (BLOCK * GROUP)
        for a in range(0, end, BLOCK * GROUP):
            raw = pack(ids[a : min(end, a + BLOCK * GROUP)])
            self.offsets.append(self.at)
            self.firsts.append(self.n)
            self.out.write(raw)
            self.at += len(raw)
            self.n += min(end, a + BLOCK * GROUP) - a
        self.pending, self.waiting = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> int:
        self._flush(True)
        for kind, x in (("<i8", self.docs), ("u1", self.nulls), ("<u8", self.sizes), ("<u8", self.offsets), ("<u8", self.firsts), ("<u8", [len(self.docs), len(self.offsets), self.at])):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(MAGIC)
        self.out.close()
        return self.n


class Reader:
    def __init__(self, path: str):
        fs, at = file_system(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self._bytes(size - 32, 32)
        if tail[24:] != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a whole file of token blocks")
        docs, groups, self.end = np.frombuffer(tail, "<u8", 3).tolist()
        foot, k = self._bytes(self.end, size - 32 - self.end), 0
        cols = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", groups), ("<u8", groups)):
            cols.append(np.frombuffer(foot, kind, n, k))
            k += cols[-1].nbytes
        self.docs, self.nulls, self.sizes, self.offsets, self.firsts = cols
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _bytes(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _group(self, g: int) -> bytes:
        a = int(self.offsets[g])
        return self._bytes(a, int(self.offsets[g + 1] if g + 1 < len(self.offsets) else self.end) - a)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``, from the blocks that hold them."""
        out = [np.zeros(0, np.uint32)]
        for g in range(max(0, int(np.searchsorted(self.firsts, start, "right")) - 1), int(np.searchsorted(self.firsts, stop))):
            first = int(self.firsts[g])
            a, b = max(0, start - first), stop - first
            out.append(unpack(self._group(g), a // BLOCK, -(-b // BLOCK))[a % BLOCK : b - a // BLOCK * BLOCK])
        return np.concatenate(out)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids), reading each group once."""
        held, at, g = np.zeros(0, np.uint32), 0, 0
        for doc, null, size in zip(self.docs.tolist(), self.nulls.tolist(), self.sizes.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < size:
                parts.append(unpack(self._group(g)))
                have += len(parts[-1])
                g += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else doc, at, held[:size]
            held, at = held[size:], at + size


class WordTokenizer(dict):
    """A tokenizer of the ``tokenizers`` library that drops white space and lower-cases, applied to each part once: the ids
    of parts, and of pieces of parts, as little-endian unsigned 32-bit integers.

    Parts are cut at spaces and line feeds. Parts of Latin letters need no normalising beyond lower case, so they are cut
    as the pre-tokenizer does, and the library's model encodes each piece; all other parts go through all of it."""

    def __init__(self, path: str):
        import os

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.model, self.level = self.inner.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        # bytes stand as printable characters; ASCII stands for itself
        shown = piece if piece.isascii() else self.level.pre_tokenize_str(piece)[0][0]
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii():
            # a word, or a word and a mark: most parts
            if part.isalpha():
                return self._piece(part)
            if part[:-1].isalpha() and part[-1] in _STOPS:
                return self[part[:-1]] + self[part[-1]]
        if _UNSAFE.search(part):
            return array("I", self.inner.encode(part, add_special_tokens=False).ids).tobytes()
        pieces = _PIECES.findall(part)
        return self._piece(part) if len(pieces) == 1 else b"".join(map(self.__getitem__, pieces))

    def __missing__(self, part: str) -> bytes:
        value = self.older.get(part)
        if value is None:
            value = self._part(part)
        self[part] = value
        return value

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        known = self.__getitem__
        return [b"".join(map(known, _parts(t))) if t else b"" for t in texts]


def _parts(text: str) -> list[str]:
    """Parts in lower case, but those with a sigma: a final one alone depends on what follows it, for Python."""
    if "Σ" in text:
        return [x if "Σ" in x else x.lower() for x in text.replace("\n", " ").split(" ")]
    return text.lower().replace("\n", " ").split(" ")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes all documents in order; (path, base, n_ids), the files in order, base the ids before each."""
    spark = docs.sparkSession
    total, most = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    n = tasks(spark, total, FILE_DOCS)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    order = [F.asc_nulls_first("doc_id"), F.asc("h")]
    # the order is the same either way; the text is hashed for the ranges' bounds only if the rows of one id can fill files
    ranges = order[:1] if (most or 0) * 10 <= FILE_DOCS else order
    dealt = rows.repartitionByRange(n, *ranges).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def make():
        import uuid

        from pyspark import TaskContext

        class Files:
            writer = None

            def __call__(self, cols):
                if self.writer is None and cols[0]:
                    # a name of its own for each attempt: the manifest has those of the attempts that count
                    self.part = TaskContext.get().partitionId()
                    self.path = f"{folder}/part-{self.part:06d}-{uuid.uuid4().hex}.pfor"
                    self.writer = Writer(self.path)
                for a in range(0, len(cols[0]), 512):
                    for doc, ids in zip(cols[0][a : a + 512], tokenizer(tokenizer_path).encode(cols[1][a : a + 512]), strict=True):
                        self.writer.add(doc, ids + end)
                return iter(())

            def finish(self):
                if self.writer is not None:
                    yield [[self.part], [self.path], [self.writer.close()]]

        return Files()

    # written at once, so that the attempts that count are known; bases by sums within and over runs of files
    found = cut_round(map_rows(dealt, ["doc_id", "text"], "part int, path string, n_ids long", make).withColumn("run", F.floor(F.col("part") / RUN)))
    before = lambda by, order: F.coalesce(F.sum("n_ids").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = found.groupBy("run").agg(F.sum("n_ids").alias("n_ids")).select("run", before([], "run").alias("run_base"))
    return found.withColumn("own", before(["run"], "part")).join(runs, "run").select("path", (F.col("run_base") + F.col("own")).alias("base"), "n_ids")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files (path, base)."""

    def make():
        def f(cols):
            for path, base in zip(*cols, strict=True):
                out = [[], [], [], []]
                for doc, start, ids in Reader(path).documents():
                    for col, x in zip(out, (doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        col.append(x)
                yield out

        return f

    n = max(1, files.count())
    return map_rows(files.repartition(n), ["path", "base"], "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read(write(docs, tokenizer_path, scratch(docs.sparkSession, "ids")))
