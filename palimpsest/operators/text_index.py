"""A stored inverted index: postings with positions, in blocks by term and zone of ids, with what bounds a block's scores.

Words of a text are posted once, with all their positions, and shuffled as packed columns of many postings. They are written in the
order of (bucket, term, zone, id), a folder for each bucket of terms, so a search reads the folders of the terms asked for, and of
these, by the files' statistics, little else. What questions have in common is read once: a zone's postings of all asked terms meet
the zone's questions in one task, which gives each question's best of the zone. So what is shuffled grows with the index and the
answers, not with the hits of each term of each question. A zone is a range of ids; a block holds at most ``BLOCK`` texts of one term and zone, the largest number of places a text of
it has and the smallest text's length. No text of a zone can score more than these allow, so a search reads the most promising
zones first and then only those that may still hold one of the best: blocks of all other zones are skipped unread.

Two scores. ``frequency``: sum over terms of (1 + ln tf) / (1 + ln words). ``proximity``: the rank that databases give to texts
with all of several words by their places: 1 - product over pairs of places of two terms, at most ``NEAR`` apart, of
(1 - 0.1 * sqrt(1 / (1.005 + 0.05 exp(d / 1.5 - 2)))); for one term 0.1 * (1 + 1/4 + 1/9 + ... tf) / 1.64493406685. All places count."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import STOP, english
from ..functions.text import words
from .joins import small
from .ranking import top_k
from .retrieval import by_block
from .state import cut_round

#: Texts of a block at most, of a zone about, folders of terms, zones that a question reads first.
BLOCK, ZONE, BUCKETS, FIRST = 128, 4096, 64, 4
#: Texts that are posted at a time, texts and bytes of text of a part of all buckets about.
POSTS, DEALT, DEALT_BYTES = 512, 50_000, 200_000_000
#: Questions of a search at a time, terms that a scan gets as a filter at most, places that are rated at a time about.
ASKED, FILTERED, RATED = 20_000, 1000, 1_000_000
#: A zone with more texts of a term than this is dealt by ids to several tasks.
FULL = 8 * ZONE
#: Blocks that are written at a time.
GIVEN = 2048
#: Places farther apart than this say nothing of each other (fixed value).
NEAR = 100
ROWS = "term string, zone long, n int, most int, least int, ids array<long>, sizes array<int>, places array<array<int>>, bucket int"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    config: str
    width: int

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/postings")


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def lexemes(w: str, config: str) -> str | None:
    """A lower-case word as it is posted: itself, or its English stem; None for a stop word."""
    return w if config == "simple" else None if w in _STOP else english(w)


_STOP = frozenset(STOP)


def build(texts: DataFrame, path: str, config: str = "simple", zone: int = ZONE) -> Index:
    """Writes the index of ``texts`` (item_id, text) to ``path``; ``config`` is simple or english. Null texts have no words."""
    spark = texts.sparkSession
    low, high, n, size = texts.agg(F.min("item_id"), F.max("item_id"), F.count("*"), F.sum(F.octet_length("text"))).first()
    width = max(1, round((high - low + 1) * zone / n)) if n else 1
    # a bucket is dealt by zones, as many parts as its texts ask for: no task has all of a term
    parts = max(1, -(-n // DEALT), -(-(size or 0) // DEALT_BYTES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for b in batches:
            for o in range(0, b.num_rows, POSTS):
                yield _packed(_posted(b.slice(o, POSTS), known, config), width, parts)

    packed = texts.filter("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).mapInArrow(post, "bucket int, part int, chunk binary")
    blocks = packed.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(lambda batches: _pack(batches, width), ROWS)
    blocks.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    spark.createDataFrame([(config, width)], "config string, width long").write.parquet(f"{path}/config")
    return Index(spark, path, config, width)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _packed(posted: pa.RecordBatch, width: int, parts: int) -> pa.RecordBatch:
    """Rows (term, item_id, size, places) as compressed columns (bucket, part, chunk), in order of term and id."""
    coded = posted.column(0).dictionary_encode()
    names = coded.dictionary.to_pylist()
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    term, names = place[coded.indices.to_numpy()], sorted(names)
    item, size, at = posted.column(1).to_numpy(), posted.column(2).to_numpy(), posted.column(3).offsets.to_numpy().astype(np.int64)
    flat, n = posted.column(3).values.to_numpy(), np.diff(at)
    own = np.array([zlib.crc32(x.encode()) % BUCKETS for x in names], np.int64)[term] if names else term
    part = item // width % parts
    order = np.lexsort((item, term, part, own))
    own, part = own[order], part[order]
    stops = np.r_[0, np.flatnonzero((own[1:] != own[:-1]) | (part[1:] != part[:-1])) + 1, len(own)] if len(own) else np.zeros(1, int)
    chunks = []
    for lo, hi in zip(stops[:-1], stops[1:], strict=True):
        some = order[lo:hi]
        first = np.flatnonzero(np.r_[True, term[some][1:] != term[some][:-1]])
        text = "\n".join(names[t] for t in term[some][first]).encode()
        ints = [np.diff(np.r_[first, hi - lo]), size[some], n[some], flat[_ragged(at[some], n[some])]]
        body = item[some].astype(np.int64).tobytes() + b"".join(x.astype(np.int32).tobytes() for x in ints) + text
        head = np.array([len(first), hi - lo, len(ints[3]), len(body)], np.int64).tobytes()
        chunks.append(head + pa.compress(body, codec="zstd", asbytes=True))
    firsts = stops[:-1]
    return pa.RecordBatch.from_arrays([pa.array(own[firsts].astype(np.int32)), pa.array(part[firsts].astype(np.int32)), pa.array(chunks, pa.binary())], ["bucket", "part", "chunk"])


def _unpacked(chunk: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, postings of each, ids, sizes, places of each posting, places)."""
    terms, posts, places, size = np.frombuffer(chunk[:32], np.int64).tolist()
    body = pa.decompress(chunk[32:], decompressed_size=size, codec="zstd", asbytes=True)
    ends = np.cumsum([8 * posts, 4 * terms, 4 * posts, 4 * posts, 4 * places])
    per, sizes, n, flat = (np.frombuffer(body[lo:hi], np.int32) for lo, hi in zip(ends[:-1], ends[1:], strict=True))
    return body[ends[-1] :].decode().split("\n"), per, np.frombuffer(body[: ends[0]], np.int64), sizes, n, flat


def _posted(b: pa.RecordBatch, known: dict[str, str | None], config: str) -> pa.RecordBatch:
    """The words (item_id, w) of texts as rows (term, item_id, size, places)."""
    sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
    coded = b.column(1).flatten().dictionary_encode()
    if len(known) > 200_000:
        known.clear()
    terms, code = [], {}
    of = np.full(len(coded.dictionary), -1)
    for i, w in enumerate(coded.dictionary.to_pylist()):
        if w not in known:
            known[w] = lexemes(w, config)
        if (t := known[w]) is not None:
            if t not in code:
                code[t] = len(terms)
                terms.append(t)
            of[i] = code[t]
    term = of[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = term >= 0
    row, place, term = row[keep], place[keep], term[keep]
    order = np.lexsort((place, term, row))
    row, place, term = row[order], place[order], term[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(place.astype(np.int32)))
    names = pa.array(terms, pa.string()).take(pa.array(term[first]))
    return pa.RecordBatch.from_arrays([names, b.column(0).take(pa.array(row[first])), pa.array(sizes[row[first]].astype(np.int32)), places], ["term", "item_id", "size", "places"])


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the chunks of each (bucket, part)."""
    key, held = None, []
    for b in batches:
        for own, part, chunk in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (own, part) != key and held:
                yield from _blocks(key[0], held, width)
                held = []
            key = (own, part)
            held.append(chunk)
    if held:
        yield from _blocks(key[0], held, width)


def _blocks(own: int, chunks: list[bytes], width: int) -> Iterator[pa.RecordBatch]:
    """Runs of postings of one (term, zone) as blocks, long runs are cut."""
    names, per, items, sizes, ns, flats = zip(*map(_unpacked, chunks), strict=True)
    every = sorted(set().union(*names))
    code = {x: i for i, x in enumerate(every)}
    term = np.concatenate([np.repeat([code[x] for x in xs], n) for xs, n in zip(names, per, strict=True)])
    item, size, n, flat = (np.concatenate(x) for x in (items, sizes, ns, flats))
    order = np.lexsort((item, term))
    term, item, size, at, n = term[order], item[order], size[order], (np.cumsum(n, dtype=np.int64) - n)[order], n[order]
    zone = item // width
    start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (zone[1:] != zone[:-1])])
    start = np.concatenate([np.arange(lo, hi, BLOCK) for lo, hi in zip(start, np.r_[start[1:], len(term)], strict=True)])
    names = pa.array(every, pa.string())
    # some blocks at a time: a bucket's places may be many
    for o in range(0, len(start), GIVEN):
        first = start[o : o + GIVEN]
        lo, hi = first[0], start[o + GIVEN] if o + GIVEN < len(start) else len(term)
        ends = pa.array(np.r_[first, hi].astype(np.int32) - np.int32(lo))
        places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[lo:hi])].astype(np.int32)), pa.array(flat[_ragged(at[lo:hi], n[lo:hi])]))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(item[lo:hi]), pa.array(size[lo:hi]), places)]
        most, least = np.maximum.reduceat(n[lo:hi], first - lo), np.minimum.reduceat(size[lo:hi], first - lo)
        columns = [names.take(pa.array(term[first])), pa.array(zone[first]), pa.array(np.diff(np.r_[first, hi]).astype(np.int32)), pa.array(most), pa.array(least), *lists, pa.array(np.full(len(first), own, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "zone", "n", "most", "least", "ids", "sizes", "places", "bucket"])


def load(spark: SparkSession, path: str) -> Index:
    r = spark.read.parquet(f"{path}/config").first()
    return Index(spark, path, r.config, r.width)


def _near(d: np.ndarray | Column):
    exp, sqrt = (F.exp, F.sqrt) if isinstance(d, Column) else (np.exp, np.sqrt)
    return 0.1 * sqrt(1.0 / (1.005 + 0.05 * exp(d / 1.5 - 2)))


_PAIR = np.log1p(-_near(np.arange(1, NEAR + 1, dtype=float)))


def proximity(places: list) -> float:
    """The score of a text by the sorted places of each asked term."""
    places = [np.asarray(x) for x in places]
    if len(places) == 1:
        return float(0.1 * (1.0 / np.arange(1, len(places[0]) + 1) ** 2).sum() / 1.64493406685)
    total = 0.0
    for i, a in enumerate(places):
        for b in places[:i]:
            few, many = (a, b) if len(a) < len(b) else (b, a)
            # how many places of the one have one of the other at each distance
            lo, hi = np.searchsorted(many, few - NEAR), np.searchsorted(many, few + NEAR, "right")
            counts = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            d = np.abs(many[at] - np.repeat(few, counts))
            total += float((np.bincount(d, minlength=NEAR + 1)[1:] * _PAIR).sum())
    return 1.0 - float(np.exp(total))


def proximities(rows: pa.Array) -> np.ndarray:
    """``proximity`` of each row (a list of lists of sorted places), all rows of a number of terms at once."""
    inner = rows.flatten()
    terms, at = np.diff(rows.offsets.to_numpy()), rows.offsets.to_numpy() - rows.offsets[0].as_py()
    flat, ends = inner.flatten().to_numpy().astype(np.int64), inner.offsets.to_numpy() - inner.offsets[0].as_py()
    out = np.zeros(len(rows))

    def of(some: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = ends[at[some] + i], ends[at[some] + i + 1]
        return flat[_ragged(lo, hi - lo)], hi - lo

    for k in np.unique(terms):
        some = np.flatnonzero(terms == k)
        out[some] = _together([of(some, i) for i in range(k)])
    return out


def _together(lists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``proximity`` of rows, of which each term has (places one row after the other, how many of each row)."""
    rows = len(lists[0][1])
    owns = [np.repeat(np.arange(rows), n) for _, n in lists]
    if len(lists) == 1:
        n = lists[0][1]
        nth = np.arange(len(owns[0])) - np.repeat(np.cumsum(n) - n, n) + 1
        return 0.1 * np.bincount(owns[0], 1.0 / nth**2, minlength=rows) / 1.64493406685
    # rows stand so far apart that their places never meet
    far = max(int(x.max(initial=0)) for x, _ in lists) + 2 * NEAR + 2
    apart, total = [(x + own * far, own) for (x, _), own in zip(lists, owns, strict=True)], np.zeros(rows)
    for i in range(len(apart)):
        for j in range(i):
            (few, own), (many, _) = sorted((apart[i], apart[j]), key=lambda x: len(x[0]))
            # the places of the one around each place of the other, some at a time
            lo, hi = np.searchsorted(many, few - NEAR), np.searchsorted(many, few + NEAR, "right")
            for o in range(0, len(few), 20_000):
                a, n = lo[o : o + 20_000], (hi - lo)[o : o + 20_000]
                d = np.abs(many[_ragged(a, n)] - np.repeat(few[o : o + 20_000], n))
                total += np.bincount(np.repeat(own[o : o + 20_000], n), _BY_DISTANCE[d], minlength=rows)
    return 1.0 - np.exp(total)


_BY_DISTANCE = np.r_[0.0, _PAIR]


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To nine places, as Spark rounds."""
    out, apart = np.round(scores, 9), np.abs(scores * 1e9 - np.floor(scores * 1e9) - 0.5)
    for i in np.flatnonzero(apart < 1e-4):
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


class _Zone:
    """What a task has of a (zone, part): who asks there, and the postings of all asked terms."""

    def __init__(self) -> None:
        self.asked: list[pa.RecordBatch] = []
        self.posted: list[pa.RecordBatch] = []

    def best(self, score: str, most: int) -> Iterator[pa.RecordBatch]:
        """(question_id, item_id, score): of each question the best texts that have all its terms."""
        if not self.asked or not self.posted:
            return
        asked, posted = pa.Table.from_batches(self.asked).combine_chunks(), pa.Table.from_batches(self.posted).combine_chunks()
        own, ids, size, places = (posted.column(x).combine_chunks() for x in ("term", "ids", "sizes", "places"))
        coded, lists = own.dictionary_encode(), places.flatten()
        code = {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
        term = np.repeat(coded.indices.to_numpy(), np.diff(ids.offsets.to_numpy()))
        item, size, n = ids.flatten().to_numpy(), size.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        order = np.lexsort((item, term))
        first, flat = (lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py())[order], lists.flatten().to_numpy().astype(np.int64)
        item, size, n = item[order], size[order], n[order].astype(np.int64)
        ends = np.searchsorted(term[order], np.arange(len(code) + 1))
        questions, k = asked.column("question_id").combine_chunks(), asked.column("best").to_numpy()
        # of questions with as many terms: (row, ids, each term's postings)
        held: dict[int, list] = {}
        load = 0
        for row, terms in enumerate(asked.column("terms").to_pylist()):
            at = [code.get(t, -1) for t in terms]
            if min(at) < 0:
                continue
            few, *others = sorted(at, key=lambda c: ends[c + 1] - ends[c])
            met = item[ends[few] : ends[few + 1]]
            for c in others:
                own = item[ends[c] : ends[c + 1]]
                met = met[own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met]
            posts = [ends[c] + np.searchsorted(item[ends[c] : ends[c + 1]], met) for c in at]
            if len(met):
                held.setdefault(len(at), []).append((row, met, posts))
                load += int(sum(n[x].sum() for x in posts)) if score != "frequency" else sum(map(len, posts))
            if load >= most:
                yield from self._rated(held, score, questions, k, first, flat, size, n)
                held, load = {}, 0
        yield from self._rated(held, score, questions, k, first, flat, size, n)

    @staticmethod
    def _rated(held: dict[int, list], score: str, questions: pa.Array, k: np.ndarray, first: np.ndarray, flat: np.ndarray, size: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for many, of in held.items():
            row = np.repeat([x[0] for x in of], [len(x[1]) for x in of])
            met = np.concatenate([x[1] for x in of])
            posts = [np.concatenate([x[2][i] for x in of]) for i in range(many)]
            if score == "frequency":
                rated = sum((1 + np.log(n[x])) / (1 + np.log(size[x])) for x in posts)
            else:
                rated = _together([(flat[_ragged(first[x], n[x])], n[x]) for x in posts])
            rated = _rounded(rated)
            order = np.lexsort((met, -rated, row))
            own = row[order]
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            nth = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
            order = order[nth < k[own]]
            yield pa.RecordBatch.from_arrays([questions.take(pa.array(row[order])), pa.array(met[order]), pa.array(rated[order])], ["question_id", "item_id", "score"])


def _scores(batches: Iterator[pa.RecordBatch], score: str, most: int) -> Iterator[pa.RecordBatch]:
    """(question_id, item_id, score) of rows in order of (zone, part, kind): questions (kind 0) and blocks (kind 1)."""
    key, held = None, _Zone()
    for b in batches:
        if not b.num_rows:
            continue
        zone, part, kind = (b.column(x).to_numpy() for x in ("zone", "part", "kind"))
        stops = np.flatnonzero((zone[1:] != zone[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *stops.tolist()], [*stops.tolist(), b.num_rows], strict=True):
            if (now := (zone[lo], part[lo])) != key:
                yield from held.best(score, most)
                key, held = now, _Zone()
            (held.posted if kind[lo] else held.asked).append(b.slice(lo, hi - lo))
    yield from held.best(score, most)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, zone, parts, ids, sizes, places) by parts: (term, zone, part, ids, sizes, places)."""
    for b in batches:
        out: list[dict] = []
        for r in b.to_pylist():
            for p in range(r["parts"]):
                some = [i for i, x in enumerate(r["ids"]) if x % r["parts"] == p]
                if some:
                    out.append({"term": r["term"], "zone": r["zone"], "part": p, **{c: [r[c][i] for i in some] for c in ("ids", "sizes", "places")}})
        if out:
            schema = pa.schema([b.schema.field("term"), b.schema.field("zone"), pa.field("part", pa.int32()), *(b.schema.field(c) for c in ("ids", "sizes", "places"))])
            yield pa.RecordBatch.from_pylist(out, schema)


def _bound(score: str) -> Column:
    """What no text can exceed that has at most ``most`` places of each term, in ``least`` words or more."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    if score == "frequency":
        return total(F.zip_with("most", "least", lambda m, n: (1 + F.ln(m)) / (1 + F.ln(n))))
    # each place has at most 2 * NEAR places of another term around it, none nearer than 1
    places, squares = total(F.col("most")), total(F.transform("most", lambda m: m * m))
    pairs = F.least((places * places - squares) / 2, places * (2.0 * NEAR) * F.size("most"))
    alone = 0.1 * total(F.transform(F.sequence(F.lit(1), F.least(F.array_max("most"), F.lit(1000))), lambda i: 1.0 / (i * i))) / 1.64493406685 + 0.1 / 1000
    return F.when(F.size("most") == 1, alone).otherwise(1 - F.exp(pairs * float(_PAIR[0])))


def search(index: Index, questions: DataFrame, k: int, score: str = "proximity") -> DataFrame:
    """(question_id, item_id, score, rank): of each question (question_id, terms) the best ``k`` texts that have all its terms.
    A question without terms finds nothing. Scores are rounded to nine places, ties rank by id."""
    config = index.config

    @F.pandas_udf("array<string>")
    def known(ws: pd.Series) -> pd.Series:
        return ws.map(lambda x: sorted({y for w in (x if x is not None else []) if (y := lexemes(w, config)) is not None}))

    def run(part: DataFrame) -> DataFrame:
        asked = cut_round(part.select("question_id", F.explode(known(words(F.col("terms")))).alias("term")).withColumn("bucket", bucket(F.col("term"))))
        need = asked.groupBy("question_id").agg(F.count("*").alias("need"), F.lit(k).alias("best"))
        each = asked.select("bucket", "term").distinct()
        terms = [(r.bucket, r.term) for r in each.limit(FILTERED + 1).collect()]
        if len(terms) <= FILTERED:  # so few folders and terms that the scan gets them as a filter
            own = index.blocks().filter(F.col("bucket").isin(sorted({b for b, _ in terms})) & F.col("term").isin(sorted({t for _, t in terms})))
        else:
            own = index.blocks().join(small(each), ["bucket", "term"], "left_semi")
        # bounds are read without ids and places
        known_of = cut_round(own.groupBy("zone", "term").agg(F.max("most").alias("most"), F.min("least").alias("least"), F.sum("n").alias("n")))
        full = known_of.groupBy("zone").agg(F.ceil(F.max("n") / F.lit(FULL)).cast("int").alias("parts")).filter("parts > 1")
        full = cut_round(full)
        if not full.isEmpty():
            own = own.join(small(full), "zone", "left")
        met = known_of.join(small(asked.select("question_id", "term")), "term")
        zones = met.groupBy("question_id", "zone").agg(F.collect_list("most").alias("most"), F.collect_list("least").alias("least"))  # as many as terms
        zones = zones.join(small(need), "question_id").filter(F.size("most") == F.col("need"))
        zones = zones.select("question_id", "zone", F.round(_bound(score) + F.lit(1e-9), 9).alias("bound"))
        zones = cut_round(zones.join(small(full), "zone", "left") if "parts" in own.columns else zones)
        first = cut_round(top_k(zones, ["question_id"], [F.col("bound").desc(), F.col("zone")], FIRST).drop("rank"))
        found = cut_round(_scored(own, asked, need, first, score))
        best = top_k(found, ["question_id"], [F.col("score").desc(), F.col("item_id")], k)
        least = best.groupBy("question_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("least"))
        rest = zones.join(first.select("question_id", "zone"), ["question_id", "zone"], "left_anti").join(small(least), "question_id", "left")
        rest = cut_round(rest.filter(F.col("bound") >= F.coalesce("least", F.lit(-1.0))).drop("bound", "least"))
        every = found.unionByName(_scored(own, asked, need, rest, score))
        return cut_round(top_k(every, ["question_id"], [F.col("score").desc(), F.col("item_id")], k))

    return by_block(questions, run, ASKED)


def _scored(own: DataFrame, asked: DataFrame, need: DataFrame, zones: DataFrame, score: str) -> DataFrame:
    """(question_id, item_id, score) of the best texts of each of some zones (question_id, zone, perhaps parts) that have all terms.
    A zone's questions and its blocks meet in a task, or in as many as the zone has parts."""
    terms = asked.groupBy("question_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).join(need, "question_id")
    dealt = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part") if "parts" in own.columns else F.lit(0).alias("part")
    wanted = zones.join(small(terms), "question_id").select("zone", dealt, F.lit(0).alias("kind"), "question_id", "terms", "best")
    blocks = own.join(zones.select("zone").distinct(), "zone", "left_semi")
    cols = ["term", "zone", "part", "ids", "sizes", "places"]
    whole = blocks.filter("parts IS NULL") if "parts" in own.columns else blocks
    rows = whole.withColumn("part", F.lit(0)).select(*cols)
    if "parts" in own.columns:
        rows = rows.unionByName(blocks.filter("parts IS NOT NULL").select("term", "zone", "parts", "ids", "sizes", "places").mapInArrow(_split, "term string, zone long, part int, ids array<long>, sizes array<int>, places array<array<int>>"))
    both = wanted.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    met = both.repartition("zone", "part").sortWithinPartitions("zone", "part", "kind")
    kind, most = dict(asked.dtypes)["question_id"], RATED
    return met.mapInArrow(lambda batches: _scores(batches, score, most), f"question_id {kind}, item_id long, score double")
