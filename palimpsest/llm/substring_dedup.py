"""Repeated lines and passages by hashing units of a text.

The units are the lines of at least ``MIN_LINE`` words, whole. What is repeated within lines or across them is found by further
units, windows of ``MIN_WORDS`` words: of any ``STEP`` windows in a row, the one whose first two words hash lowest, so that a passage
of ``MIN_WORDS + STEP - 1`` words, 41, has a unit in common wherever it stands. Units are normalised (A-Z lower-cased, words joined
by a space) and their digests grouped over all documents. The earliest occurrence by (doc_id, text hash, place) is kept, all others
go; units that overlap or follow each other and go are one span. So every word that goes stands in a line or in ``MIN_WORDS`` words
that stand earlier too, and a repeated line goes from its first word to its last. Of a passage within a line up to ``STEP - 1`` words
can stay at each end. Shorter lines are no units: they repeat by chance and as boilerplate, which line dedup judges by frequency.

Offsets are code points of the original text. Nulls and texts of fewer words have no units. Rows with equal doc_id and text
count as one document and lose the same spans. Null doc_ids rank last. Extra columns pass through ``clean``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, lookup, map_rows

MIN_WORDS, STEP, MIN_LINE = 25, 17, 16
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_CODE = np.where(_SPACE, 0, np.random.default_rng(8).integers(1, 2**63, 256)).astype(np.uint64)


def chosen(h: np.ndarray) -> set[int]:
    """Of any ``STEP`` places in a row (of all, where there are fewer) the last lowest, by all bits but the last few."""
    bits = np.uint64((1 << len(h).bit_length()) - 1)
    low = h & ~bits | np.arange(len(h), dtype=np.uint64)[::-1]
    wide, need = 1, min(STEP, len(h))
    while wide < need:
        by = min(wide, need - wide)
        low, wide = np.minimum(low[:-by], low[by:]), wide + by
    return set((len(h) - 1 - (low & bits).astype(np.int64)).tolist())


def units(text: str | None, size: int = MIN_WORDS, line: int = MIN_LINE) -> list[tuple[int, int, list[bytes], int]]:
    """(start, stop, normalised words, place of the first word) of each unit, in order of places."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    w = raw.split()
    if len(w) < min(size, line):
        return []
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    edges = (np.flatnonzero(space[1:] != space[:-1]) + 1).tolist()
    edges = np.array([0] * (not space[0]) + edges + [len(b)] * (not space[-1]))
    starts, stops = edges[::2], edges[1::2]
    ends = [0, *np.searchsorted(starts, np.flatnonzero(b == 10)).tolist(), len(w)]
    found = {(x, y - x) for x, y in zip(ends, ends[1:], strict=False) if y - x >= line}
    last = len(w) - size
    if last >= 0:
        code = _CODE[b]
        code[1:] *= code[:-1] | np.uint64(1)
        h = np.add.reduceat(code, starts)
        # of the first word and, so that a common word isn't always lowest, the second
        h[:-1] += h[1:] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        found |= {(p, size) for p in chosen(h[: last + 1])}
    if not found:
        return []
    first, n = np.array(sorted(found)).T
    begin, end = starts[first], stops[first + n - 1]
    if len(raw) > len(text):
        before = np.cumsum(b & 0xC0 != 0x80)
        begin, end = before[begin] - 1, before[end - 1]
    return [(x, y, w[p : p + m], p) for x, y, p, m in zip(begin.tolist(), end.tolist(), first.tolist(), n.tolist(), strict=True)]


def _rows(docs: DataFrame, size: int) -> DataFrame:
    """Every unit: its digest, document, place among the document's units, offsets, place of its first word and number of words."""

    def make():
        import xxhash

        def f(cols):
            for a in range(0, len(cols[0]), 2000):
                out = [[] for _ in range(9)]
                for doc, th, text in zip(*(c[a : a + 2000] for c in cols), strict=True):
                    for k, (start, stop, w, at) in enumerate(units(text, size)):
                        d = xxhash.xxh3_128_intdigest(b" ".join(w))
                        for col, x in zip(out, ((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), doc, th, k, start, stop, at, len(w)), strict=True):
                            col.append(x)
                yield out

        return f

    # rows that are alike are one document
    one = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return map_rows(one, ["doc_id", "th", "text"], "h1 long, h2 long, doc_id long, th long, k int, start int, stop int, at int, n int", make)


def _rank():
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "k")


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, start, stop, n_words, kept_doc_id): what goes, and which document keeps the first unit of it."""
    rows = _rows(docs, min_words)
    known = rows.groupBy("h1", "h2").agg(F.min(_rank()).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    known = cut(known)
    total = known.agg(F.sum("copies")).first()[0] or 0
    met = lookup(rows, known, ["h1", "h2"], "copies", total, ["doc_id", "th", "k"])
    later = met.filter(F.col("copies").isNotNull() & ~F.col("first").eqNullSafe(_rank()))
    # a set: rows that are alike give each unit again, which tasks drop before the shuffle
    per = later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("k", "start", "stop", "at", "n", F.col("first.doc_id").alias("kept")))).alias("u"))

    def make():
        def f(cols):
            out = [[] for _ in range(6)]
            for doc, th, own in zip(*cols, strict=True):
                run, end = [], 0
                for x in [*own, None]:
                    if run and (x is None or x["at"] > end):
                        for col, y in zip(out, (doc, th, run[0]["start"], max(u["stop"] for u in run), end - run[0]["at"], run[0]["kept"]), strict=True):
                            col.append(y)
                        run = []
                    if x is not None:
                        run.append(x)
                        end = max(end, x["at"] + x["n"])
            yield out

        return f

    return map_rows(per, ["doc_id", "th", "u"], "doc_id long, th long, start int, stop int, n_words int, kept_doc_id long", make)


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the spans taken out of ``text``, and removed_spans, their original offsets."""
    others = [c for c in docs.columns if c not in ("text", "removed_spans")]
    doc, th, own, n, seq = (fresh(docs, x) for x in ("sub_doc", "sub_th", "sub_spans", "sub_rows", "sub_seq"))
    # rows that are alike, of any number, meet their spans by the count of their key
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(doc), F.xxhash64("text").alias(th)]
    gone = spans(docs, min_words).groupBy(key[0], F.col("th").alias(th)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(own))
    few = cut(docs.select(*key).groupBy(doc, th).agg(F.count("*").alias(n)).join(gone, [doc, th]))
    rows = lookup(docs.withColumns({doc: key[0], th: key[1], seq: F.monotonically_increasing_id()}), few, [doc, th], n, docs.count(), [seq])

    def make():
        def f(cols):
            texts, marks = [], []
            for text, own in zip(cols[-2], cols[-1], strict=True):
                kept, at, gone = [], 0, []
                for x in own or ():
                    # spans can overlap
                    if gone and x["start"] <= at:
                        gone[-1]["stop"] = at = max(at, x["stop"])
                        continue
                    kept.append(text[at : x["start"]])
                    at = x["stop"]
                    gone.append({"start": x["start"], "stop": at})
                texts.append(text if text is None else "".join(kept) + text[at:])
                marks.append(gone)
            yield [*cols[:-2], texts, marks]

        return f

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + ["text string", "removed_spans array<struct<start:int,stop:int>>"])
    return map_rows(rows, [*(f"`{c}`" for c in others), "text", own], schema, make)
