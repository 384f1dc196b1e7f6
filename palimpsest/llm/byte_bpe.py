"""Byte-level BPE in padded numpy matrices.

Texts are cut where no piece of the pattern can cross. Parts and pieces seen before come from a table, new pieces are merged
together: pieces of similar length are the rows of a padded matrix of ids; each round every row merges its leftmost pair
of minimum rank, found by hashed lookup of id pairs, and closes the gap; finished rows leave the matrix. A piece beyond
``LONGEST_ROW`` bytes is a row of its own. Where every merge ranks above its parts, as in all trained vocabularies, a round
merges all places of that row's minimum pair, left to right: no lower rank can come up in between, so the ids are the same.

Nulls are empty texts, which have no ids. Rows are independent, so repeated rows have equal results; texts and pieces of any
length are encoded whole; ids are decoded back to exactly the bytes that were encoded. Extra columns pass through ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

NO_RANK = np.int32(2**31 - 1)
#: Longer pieces are rows of their own.
LONGEST_ROW = 256
#: Parts of text and pieces that a worker remembers: between once and twice as many, the latest.
REMEMBERED = 250_000
_SIZES = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONGEST_ROW)
#: By length of a piece, the width of its matrix.
_ROW = [min(s for s in _SIZES if s >= n) for n in range(LONGEST_ROW + 1)]

# In these texts Python's own patterns cut as \p{L} and \p{N} would: no code points from U+0250, no ²³¹¼½¾, no
# separators U+001C to U+001F. All of U+0100 to U+024F are letters.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_UNSAFE = re.compile("[^\0-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
#: No piece crosses a space between two characters that are not white space, as it starts the next piece.
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
# A text may not be cut before each space and line feed where it has other white space, three of them in a row or two at
# the end, or the mark that is put there.
_OTHER_SPACE = re.compile("[\0\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUN = re.compile(r"[ \n]{3}|[ \n]{2}\Z")
_STOPS = frozenset(".,;:!?")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.latin = _LATIN if pattern == r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""" else None
        self.single = np.array([ranks[bytes([c])] for c in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self._hash(np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        #: No merge ranks below one of its parts.
        self.grows = all(rank > max(a >> 20, a & 0xFFFFF) for a, rank in pairs.items())
        n = max(ranks.values()) + 1
        self._decoding(n)
        #: Ids as little-endian u32 of each part of text.
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _decoding(self, n: int) -> None:
        """Tables by id: the decimals and a comma in 0-padded columns; the bytes, laid end to end."""
        width = len(str(n - 1)) + 1
        self.decimals = np.zeros((n, width), np.uint8)
        number = np.arange(n)
        for k in range(width - 1):
            high = 10 ** (width - 2 - k)
            self.decimals[:, k] = np.where((number >= high) | (high == 1), number // high % 10 + 48, 0)
        self.decimals[:, -1] = 44
        whole = [self.bytes_of.get(i, b"") for i in range(n)]
        self.sizes = np.array([len(x) for x in whole], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.whole = np.frombuffer(b"".join(whole), np.uint8)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear steps; all keys try their next place at once until each has one."""
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == -1
            places, first = np.unique(at[left][free], return_index=True)
            won = left[free][first]
            self.keys[places], self.values[places] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; negative ids are padding."""
        keys = (a.astype(np.int64) << 20) | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NO_RANK)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            own = self.keys[at[open_]]
            hit = own == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (own != -1)]
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian u32."""
        get = self.ranks.get
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole, n = get(piece), len(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif n > LONGEST_ROW:
                out[i] = self._merge_long(piece)
            elif n:
                by_size.setdefault(_ROW[n], []).append(i)
        for size, own in by_size.items():
            step = max(1, 2_000_000 // size)
            for k in range(0, len(own), step):
                self._merge_rows([pieces[i] for i in own[k : k + step]], own[k : k + step], size, out)
        return out

    def _merge_rows(self, pieces: list[bytes], places: list[int], size: int, out: list) -> None:
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        columns = np.arange(size)
        ids = np.where(columns[None, :] < lengths[:, None], self.single[raw], np.int32(-1))
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
        rows = np.arange(n)
        while True:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(ids)), at]
            going = low != NO_RANK
            if not going.all():
                done = ids[~going]
                some = done >= 0
                flat, end = done[some].astype("<u4").tobytes(), np.cumsum(some.sum(1)) * 4
                a = 0
                for r, z in zip(rows[~going].tolist(), end.tolist(), strict=True):
                    out[places[r]] = flat[a:z]
                    a = z
                ids, ranks, rows, at, low = ids[going], ranks[going], rows[going], at[going], low[going]
            if not len(ids):
                return
            r = np.arange(len(ids))
            ids[r, at] = low
            after = columns[None, 1:-1] > at[:, None]
            ids[:, 1:-1] = np.where(after, ids[:, 2:], ids[:, 1:-1])
            ids[:, -1] = -1
            if size > 2:
                after = columns[None, : size - 2] >= at[:, None]
                ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = NO_RANK
            else:
                ranks[:] = NO_RANK
            right = np.minimum(at + 1, size - 1)
            has = at < size - 1
            ranks[r[has], at[has]] = self.rank(ids[r, at], np.where(has, ids[r, right], -1))[has]
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.rank(ids[left, at[left] - 1], ids[left, at[left]])

    def _merge_long(self, piece: bytes) -> bytes:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) != NO_RANK:
            at = np.flatnonzero(ranks == low)
            if self.grows:
                # of places in a row, as in "aaaa", every other one
                first = np.r_[True, at[1:] != at[:-1] + 1]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            else:
                at = at[:1]
            ids[at] = low
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))
            ids = ids[stay]
            # the pair that starts at a place that went is gone; those that end or start at a merged place are new
            ranks = ranks[stay[1:]]
            for new in (at[at > 0] - 1, at[at < len(ids) - 1]):
                ranks[new] = self.rank(ids[new], ids[new + 1])
        return ids.astype("<u4").tobytes()

    def cut(self, text: str) -> list[str]:
        """Parts that no piece crosses."""
        two = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        if two and _RUN.search(text) or _OTHER_SPACE.search(text):
            return _SAFE_CUT.split(text)
        # every space and line feed starts a part
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return parts if parts[0] else parts[1:]

    def pieces(self, part: str) -> list[str]:
        if self.latin:
            if part.isascii():
                # a word, or a word and a mark: most parts
                body = part[1:] if part[0] == " " else part
                if body.isalpha():
                    return [part]
                if body[:-1].isalpha() and body[-1] in _STOPS:
                    return [part[:-1], part[-1]]
            if not _UNSAFE.search(part):
                return self.latin.findall(part)
        return self.pattern.findall(part)

    def learn(self, parts: list[str]) -> None:
        """Encodes parts of text; then ``known`` has them and their pieces."""
        known, older = self.known, self.older
        cut = [self.pieces(p) for p in parts]
        new = []
        for x in {x for own in cut for x in own}.difference(known):
            if x in older:
                known[x] = older[x]
            else:
                new.append(x)
        known.update(zip(new, self.merge([x.encode("utf-8", "surrogatepass") for x in new]), strict=True))
        for part, own in zip(parts, cut, strict=True):
            if len(own) > 1:
                known[part] = b"".join([known[x] for x in own])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids, as little-endian u32."""
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {"": b""}
        known, older = self.known, self.older
        new = []
        for p in set().union(*cut).difference(known):
            if p in older:
                known[p] = older[p]
            else:
                new.append(p)
        if new:
            self.learn(new)
        get = known.__getitem__
        return [b"".join(map(get, own)) for own in cut]

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimals, joined by commas."""
        flat = self.decimals[ids].ravel()
        return flat[flat != 0].tobytes()[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.sizes[ids]
        return self.whole[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.starts[ids], n)].tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(path), pattern)


#: Texts that are encoded together.
TOGETHER = 512
#: Ids that are written or decoded at a time.
IDS = 1 << 16


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) by the ranks at ``path``."""

    def make():
        bpe = tokenizer(path, pattern)

        def f(cols):
            for a in range(0, len(cols[0]), TOGETHER):
                out = [cols[0][a : a + TOGETHER], [], [], []]
                for raw in bpe.encode(cols[1][a : a + TOGETHER]):
                    ids = np.frombuffer(raw, "<u4")
                    written, decoded = hashlib.sha256(), hashlib.sha256()
                    for k in range(0, len(ids), IDS):
                        written.update(b"," * bool(k) + bpe.written(ids[k : k + IDS]))
                        decoded.update(bpe.decode(ids[k : k + IDS]))
                    out[1].append(len(ids))
                    out[2].append(written.hexdigest())
                    out[3].append(decoded.hexdigest())
                yield out

        return f

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encode(docs: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """``docs`` with ``column``, the ids of ``text`` as an array; a column of that name is replaced."""
    others = [c for c in docs.columns if c != column]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"`{column}` array<int>"])
    text = others.index("text")

    def make():
        bpe = tokenizer(path, pattern)

        def f(cols):
            for a in range(0, len(cols[0]), TOGETHER):
                part = [c[a : a + TOGETHER] for c in cols]
                yield [*part, [np.frombuffer(raw, "<i4") for raw in bpe.encode(part[text])]]

        return f

    return map_rows(docs, [f"`{c}`" for c in others], schema, make)


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    return tokenizer(path, pattern).decode(np.array(ids, np.int64))
