"""Ingest: domains, redaction, hashing, chunking, deduplication, edits and removals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinds, scores, text
from .joins import small
from .state import cut_round
from .supersede import closings

MAX_CHARS, OVERLAP, MIN_CHARS, LONGEST, MAX_CHUNKS, MAX_METADATA = 1500, 200, 100, 200_000, 400, 16_384
CHUNK = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("content", T.StringType())]))


def fixed_chunks(content: Column, size: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters, each ``overlap`` into the one before; pure SQL."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.char_length(content) - overlap) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("position"), F.substr(content, i * step + 1, F.lit(size)).alias("content")))


_SENTENCE_ENDS = [p + w for p in ".!?" for w in " \n"]


def _end(s: str, low: int, stop: int) -> int:
    """Where a chunk ends that may go up to ``stop`` and looks for a mark from ``low`` on."""
    at = s.rfind("\n\n", max(low - 1, 0), stop)
    if at >= 0:
        return at + 2
    # white space after a sentence may stand just beyond the chunk
    at = max(s.rfind(p, max(low, 1), stop + 1) for p in _SENTENCE_ENDS)
    if at < 0:
        at = max(s.rfind(" ", low, stop), s.rfind("\n", low, stop))
    return at + 1 if at >= 0 else stop


def chunk(s: str, size: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> list[tuple[int, str]]:
    """Chunks of at most ``size`` characters, each ``overlap`` into the one before; a short tail joins the chunk before.

    A chunk ends after the last blank line in its last 30 %, else after the last sentence there, else after the last space;
    nothing else of it is searched."""
    if size <= 0 or len(s) <= size:
        return [(0, s)]
    overlap = size // 4 if overlap >= size else max(0, overlap)
    spans: list[tuple[int, int]] = []
    start = 0
    while start + size < len(s):
        stop = _end(s, max(start, start + size - max(10, size * 30 // 100)), start + size)
        spans.append((start, stop))
        # an overlap that would lead back to where the chunk began is left out
        start = stop - overlap if stop - overlap > start else stop
    if start < len(s):
        spans.append((start, len(s)))
    out = [piece for a, z in spans if (piece := s[a:z].strip())]
    if len(out) >= 2 and len(out[-1]) < least:
        tail = out.pop()
        out[-1] += " " + tail
    return list(enumerate(out)) or [(0, "")]


def boundary_chunks(content: Column, size: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> Column:
    """As ``chunk``, in Arrow batches."""
    @F.pandas_udf(CHUNK)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [{"position": p, "content": c} for p, c in chunk(s or "", size, overlap, least)])

    return cut(content)


class Chunker:
    """A table function: the chunks (position, content) of a text."""

    def eval(self, content: str, size: int, overlap: int, least: int):
        yield from chunk(content or "", size, overlap, least)


def register_chunker(spark: SparkSession, name: str = "chunk_text") -> None:
    """Makes the chunker a table function of SQL: ``FROM documents d, LATERAL chunk_text(d.text, 1500, 200, 100) c``. Rows go to it
    a hundred at a time: Arrow's batches are of ten thousand texts of any length, all of which a worker would have as objects."""
    spark.udtf.register(name, F.udtf(Chunker, returnType="position int, content string", useArrow=False))


def prepare(raw: DataFrame) -> DataFrame:
    """Rows (page_id, domain, content) as they are stored: known domain, secrets masked, cut to length, hashed."""
    masked, n = text.redact(F.col("content"))
    clean = raw.withColumn("domain", kinds.input_domain(F.col("domain"))).withColumn("redactions", n).withColumn("content", F.substring(masked, 1, LONGEST))
    return clean.withColumn("content_hash", text.content_hash(F.col("content")))


def exact_dedup(new: DataFrame, current: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """New pages whose hash is neither stored in their scope nor earlier in the batch."""
    key = [*scope, "content_hash"]
    on = F.lit(True)
    own = current.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    fresh = new.join(own, on, "left_anti")
    first = Window.partitionBy(*key).orderBy(*order)
    return fresh.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def semantic_supersede(pages: DataFrame, scope: list[str], near: float) -> DataFrame:
    """(page_id, superseded_by) of all pages, by ``supersede.closings``."""
    return pages.select("page_id").join(closings(pages, scope, near), "page_id", "left")


def soft_delete(pages: DataFrame, chunks: DataFrame, gone: DataFrame, moment: Column) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id) are closed at ``moment``, their chunks go."""
    ids = small(gone.select("page_id").distinct().withColumn("_gone", F.lit(True)))
    marked = pages.join(ids, "page_id", "left")
    closed = marked.withColumn("valid_to", F.when(F.col("_gone") & F.col("valid_to").isNull(), moment).otherwise(F.col("valid_to"))).drop("_gone")
    return closed, chunks.join(ids, "page_id", "left_anti")


def compiled_upsert(new: DataFrame, old: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The stored page that each compiled page replaces: of the same slug, else the most similar text, else none.

    new and old: (id, scope, slug, content); texts are compared by their first 500 characters, within a scope. What is very similar
    is looked for first, as that takes few candidates, and a page that has found its best is done. Equal trigram sets of a scope are
    one candidate, so copies are not all pairs. Where texts have so few rare trigrams that nearly all would be candidates, what is
    left is compared in blocks."""
    exact = new.alias("n").join(old.alias("o"), (F.col("n.scope") == F.col("o.scope")) & (F.col("n.slug") == F.col("o.slug"))).groupBy(F.col("n.id").alias("id")).agg(F.min("o.id").alias("target"))
    rest = new.join(exact, "id", "left_anti")
    code = lambda g: F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 21) + F.ascii(F.substr(g, i, F.lit(1))))
    sets = lambda df: df.select("id", "scope", F.array_sort(F.transform(scores.trigrams(F.substring("content", 1, 500)), code)).alias("t")).filter("size(t) > 0").withColumn("k", F.xxhash64("scope", "t"))
    classes = lambda df: cut_round(df.groupBy("k").agg(F.min("id").alias("id"), F.first("scope").alias("scope"), F.first("t").alias("t")))
    asked = cut_round(sets(rest))
    a, b = classes(asked), classes(sets(old))
    each = a.select("scope", F.explode("t").alias("g")).unionByName(b.select("scope", F.explode("t").alias("g")))
    often = _often(each.groupBy("scope", "g").agg(F.count("*").alias("df")).orderBy(F.col("df").desc(), "scope", "g").limit(OFTEN).collect())
    # a set's trigrams stay one row, the rarest first; only what a join needs of them becomes rows, which aren't stored
    a, b = (cut_round(df.mapInArrow(lambda batches: _rarest_first(batches, often), df.schema)) for df in (a, b))
    placed = lambda df: df.select("k", "scope", F.size("t").alias("n"), F.posexplode("t").alias("r", "g")).withColumn("r", F.col("r") + 1)
    best_of = lambda sim: cut_round(sim.groupBy("k").agg(F.min_by("target", F.struct(-F.col("sim"), F.col("target"))).alias("target")))
    mine, theirs, left, found = placed(a), placed(b), a.select("k"), None
    for t in sorted({threshold, *(x for x in STAGES if x > threshold)}, reverse=True):
        some = mine.join(small(left), "k", "left_semi")
        if dense := _meetings(some, theirs, t) > max(MEETINGS, _pairs(some, theirs) * SHARED):
            break
        best = best_of(_verified(upsert_candidates(some, theirs, t), a, b, t))
        found = best if found is None else found.unionByName(best)
        left = cut_round(left.join(best, "k", "left_anti"))
    if dense:
        best = best_of(compared_in_blocks(a.join(left, "k", "left_semi"), b, threshold, often))
        found = best if found is None else found.unionByName(best)
    done = asked.join(found, "k").select("id", "target")
    return new.select("id").join(exact.unionByName(done), "id", "left")


#: Similarities at which a best page is looked for first: what is found at one of them needs no lower one.
STAGES = (0.9, 0.75)
#: Where rare trigrams would meet more often than this, and than this share of all pairs, all pairs are compared in blocks.
MEETINGS, SHARED = 5_000_000, 0.05
#: Sets of a block on either side at most, about; sets that are multiplied at a time, and of a scope's trigrams the most frequent.
ASKED, STORED, SETS, GRAMS = 32_768, 131_072, 2048, 512
#: Trigrams of scopes whose frequency is known at most, others count as rarer; trigrams and pairs that are looked at at a time.
OFTEN, COLUMNS, LOOKED = 100_000, 4096, 200_000
#: A trigram that is looked up takes as long as so many that are multiplied, about.
DEARER = 2000


def _prefix(df: DataFrame, t: float) -> DataFrame:
    return df.filter(F.col("r") <= F.col("n") - F.ceil(t * F.col("n")) + 1)


def _meetings(mine: DataFrame, theirs: DataFrame, t: float) -> int:
    """How many rows the prefixes' join has."""
    of = lambda df, x: _prefix(df, t).groupBy("scope", "g").agg(F.count("*").alias(x))
    return of(mine, "a").join(of(theirs, "b"), ["scope", "g"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0


def _pairs(mine: DataFrame, theirs: DataFrame) -> int:
    """How many pairs of sets share a scope."""
    of = lambda df, x: df.filter("r = 1").groupBy("scope").agg(F.count("*").alias(x))
    return of(mine, "a").join(of(theirs, "b"), "scope").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0


def _often(rows: list) -> dict:
    """{scope: (trigrams in order, how frequent each is)} of rows (scope, g, df)."""
    out: dict = {}
    for r in rows:
        out.setdefault(r.scope, []).append((r.g, r.df))
    return {k: tuple(np.array(sorted(v), np.int64).T) for k, v in out.items()}


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _by_scope(scope: pa.Array, t: pa.Array) -> Iterator[tuple]:
    """(scope, rows, the rows' sizes, their trigrams one row after the other)."""
    coded, ends, flat = scope.dictionary_encode(), t.offsets.to_numpy().astype(np.int64), t.values.to_numpy()
    sizes, of = np.diff(ends), coded.indices.to_numpy(zero_copy_only=False)
    for c, name in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(of == c)
        n = sizes[rows]
        yield name, rows, n, flat[np.repeat(ends[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _at(known: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each of ``g`` in ``known``, whether it is there)."""
    if not len(known):
        return np.zeros(len(g), np.int64), np.zeros(len(g), bool)
    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
    return at, known[at] == g


def _rarest_first(batches: Iterator[pa.RecordBatch], often: dict) -> Iterator[pa.RecordBatch]:
    """Sets (k, id, scope, t), the trigrams of each in the order of (frequency in the scope, trigram)."""
    for b in batches:
        # groups of equal scopes don't keep the rows' order; a set without scope meets none
        for name, rows, n, g in _by_scope(b.column(2), b.column(3)):
            known, df = often.get(name, _NONE)
            at, there = _at(known, g)
            rare = np.zeros(len(g), np.int64)
            rare[there] = df[at[there]]
            order = np.lexsort((g, rare, np.repeat(np.arange(len(rows)), n)))
            t = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(g[order]))
            part = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], t], ["k", "id", "scope", "t"])


def _bits(batches: Iterator[pa.RecordBatch], often: dict, grams: int) -> Iterator[pa.RecordBatch]:
    """Sets (id, scope, t) as (id, scope, n, bits, rare): a bit for each of the scope's ``grams`` most frequent trigrams, and the
    others."""
    for b in batches:
        for name, rows, n, g in _by_scope(b.column(1), b.column(2)):
            known, df = often.get(name, _NONE)
            most = np.sort(known[np.argsort(-df, kind="stable")[:grams]])
            at, there = _at(most, g)
            own = np.repeat(np.arange(len(rows)), n)
            x = np.zeros((len(rows), len(most)), bool)
            x[own[there], at[there]] = True
            left = np.bincount(own[~there], minlength=len(rows))
            rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)].astype(np.int32)), pa.array(g[~there]))
            part = b.take(pa.array(rows))
            bits = pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n.astype(np.int32)), bits, rare], ["id", "scope", "n", "bits", "rare"])


def compared_in_blocks(a: DataFrame, b: DataFrame, threshold: float, often: dict) -> DataFrame:
    """(k, target, sim): of each set of ``a`` (k, scope, t) the most similar of each block of ``b`` (id, scope, t), the least id of
    equal ones, from ``threshold`` on. Every set of a scope meets every other: blocks of both sides meet in a group, whose memory
    is bounded. Sets go there as bits of frequent trigrams and the few rare ones, as each goes to many groups; what they share of
    the frequent ones is counted as products of matrices, and of the rare ones where these can still decide."""
    grams, sets, kind = GRAMS, SETS, dict(a.dtypes)["scope"]
    packed = f"id long, scope {kind}, n int, bits binary, rare array<long>"
    a, b = (cut_round(df.select(F.col(x).alias("id"), "scope", "t").mapInArrow(lambda batches: _bits(batches, often, grams), packed)) for df, x in ((a, "k"), (b, "id")))
    # enough groups for all cores, larger ones only beyond that: a set goes to fewer
    stored = max(1, min(STORED, max(STORED // 64, -(-b.count() // (4 * b.sparkSession.sparkContext.defaultParallelism)))))
    of = lambda df, size, x: df.groupBy("scope").agg(F.ceil(F.count("*") / size).cast("int").alias(x))
    # scopes may be many: their counts meet by a join
    grid = cut_round(of(a, ASKED, "na").join(of(b, stored, "nb"), "scope"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key, cols = ["scope", "i", "j", "kind"], ["id", "n", "bits", "rare"]
    one = a.join(grid, "scope").withColumns({"i": part("na"), "j": every("nb"), "kind": F.lit(0)}).select(*key, *cols)
    two = b.join(grid, "scope").withColumns({"i": every("na"), "j": part("nb"), "kind": F.lit(1)}).select(*key, *cols)
    groups = grid.agg(F.sum(F.col("na").cast("long") * F.col("nb"))).first()[0] or 1
    dealt = one.unionByName(two).repartition(min(groups, 2000), "scope", "i", "j").sortWithinPartitions(*key)
    return dealt.mapInArrow(lambda batches: _products(batches, threshold, sets), "k long, target long, sim double")


def _products(batches: Iterator[pa.RecordBatch], threshold: float, sets: int) -> Iterator[pa.RecordBatch]:
    """Over rows in order of (scope, i, j, kind): the sets that ask, then those that they are compared with."""
    key, held, asked = None, [], None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if asked is not None and held:
            yield _best_of(asked, _Sets(held), threshold, sets)
        held = []

    for b in batches:
        if not b.num_rows:
            continue
        scope, (i, j, kind) = b.column(0).dictionary_encode().indices.to_numpy(), (b.column(x).to_numpy() for x in (1, 2, 3))
        stops = (np.flatnonzero((scope[1:] != scope[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist()
        for lo, hi in zip([0, *stops], [*stops, b.num_rows], strict=True):
            now = (b.column(0)[lo].as_py(), i[lo], j[lo], kind[lo])
            if now != key:
                if key is not None and now[:3] != key[:3]:
                    yield from flush()
                    asked = None
                elif key is not None:
                    asked, held = _Sets(held), []
                key = now
            for o in range(lo, hi, sets):
                held.append(b.slice(o, min(sets, hi - o)))
                if kind[lo] == 1 and sum(x.num_rows for x in held) >= sets:
                    yield from flush()
    yield from flush()


class _Sets:
    """Sets of a scope, from rows (.., id, n, bits, rare)."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        self.ids, self.n = rows.column("id").to_numpy(), rows.column("n").to_numpy().astype(np.float32)
        self.bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        rare = rows.column("rare").combine_chunks()
        self.rare, self.rares = rare.flatten().to_numpy(), np.diff(rare.offsets.to_numpy()).astype(np.int64)
        self.starts = np.cumsum(self.rares) - self.rares

    def matrix(self, lo: int, hi: int) -> np.ndarray:
        return np.unpackbits(self.bits[lo:hi], axis=1).astype(np.float32)

    def few(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``rows``, trigram) of their rare trigrams."""
        n = self.rares[rows]
        return np.repeat(np.arange(len(rows)), n), self.rare[np.repeat(self.starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _rare_in_common(a: _Sets, b: _Sets, lo: int, hi: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many rare trigrams the pairs (``i``, from ``lo`` on, and ``j``) share."""
    known = np.unique(b.rare)
    row_b, g = b.few(np.arange(len(b.ids)))
    at_b = np.searchsorted(known, g)
    # looked up pair by pair, or where that is more than multiplying all, multiplied
    if a.rares[lo + i].sum() * DEARER > (hi - lo) * len(b.ids) * len(known):
        row, g = a.few(np.arange(lo, hi))
        at, there = _at(known, g)
        row, at, common = row[there], at[there], np.zeros((hi - lo, len(b.ids)), np.float32)
        for c in range(0, len(known), COLUMNS):
            x, y = (np.zeros((n, min(COLUMNS, len(known) - c)), np.float32) for n in common.shape)
            for m, r, p in ((x, row, at), (y, row_b, at_b)):
                inside = (p >= c) & (p < c + COLUMNS)
                m[r[inside], p[inside] - c] = 1
            common += x @ y.T
        return common[i, j]
    keys, out = np.sort(row_b * len(known) + at_b), np.zeros(len(i), np.float32)
    for o in range(0, len(i), LOOKED):
        pair, g = a.few(lo + i[o : o + LOOKED])
        at, there = _at(known, g)
        pair, at = pair[there], at[there]
        _, hit = _at(keys, j[o : o + LOOKED][pair] * len(known) + at)
        out[o : o + LOOKED] = np.bincount(pair[hit], minlength=len(i[o : o + LOOKED]))
    return out


def _best_of(a: _Sets, b: _Sets, threshold: float, sets: int) -> pa.RecordBatch:
    out: list[list[np.ndarray]] = [[], [], []]
    every, rare_b = b.matrix(0, len(b.ids)).T, b.rares.astype(np.float32)
    for o in range(0, len(a.ids), sets):
        hi = min(o + sets, len(a.ids))
        own, rare = a.n[o:hi], a.rares[o:hi].astype(np.float32)
        common = a.matrix(o, hi) @ every
        # what is similar enough shares at least so many
        part = np.float32(threshold / (1 + threshold))
        need = (part * own - np.float32(1e-3))[:, None] + part * b.n
        i, j = np.nonzero(common + np.minimum(rare[:, None], rare_b) >= need)
        shared = common[i, j] + _rare_in_common(a, b, o, hi, i, j) if len(i) else common[i, j]
        likely = shared >= need[i, j]
        i, j, shared = i[likely], j[likely], shared[likely].astype(np.float64)
        sim = np.round(shared / (own[i].astype(np.float64) + b.n[j] - shared), 9)
        order = np.lexsort((b.ids[j], -sim, i))
        order = order[sim[order] >= threshold]
        first = order[np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]])] if len(order) else order
        for x, v in zip(out, (a.ids[o + i[first]], b.ids[j[first]], sim[first]), strict=True):
            x.append(v)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["k", "target", "sim"])


def upsert_candidates(mine: DataFrame, theirs: DataFrame, t: float) -> DataFrame:
    """(a, b) of trigram sets (k, scope, n, g, r: the place of g among the set's, the rarest first) that may be ``t`` similar.

    Both have one of their first n - ceil(t * n) + 1 in common. How many these are, and how many can still come after the last of
    them, bounds how many they share at all."""

    def prefix(df: DataFrame, x: str) -> DataFrame:
        return _prefix(df, t).select(F.col("k").alias(x), "scope", "g", F.col("n").alias(f"n{x}"), F.col("r").alias(f"r{x}"))

    close = (F.col("na") >= t * F.col("nb")) & (F.col("nb") >= t * F.col("na"))
    need = t / (1 + t) * (F.col("na") + F.col("nb")) - 1e-6
    met = prefix(mine, "a").join(prefix(theirs, "b"), ["scope", "g"]).filter(close & (F.least("ra", "rb") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= need))
    per = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    return per.filter(F.col("c") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= need).select("a", "b")


def _verified(met: DataFrame, a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    both = met.join(a.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(b.select(F.col("k").alias("b"), F.col("id").alias("target"), F.col("t").alias("tb")), "b")
    n = F.size(F.array_intersect("ta", "tb"))
    return both.select(F.col("a").alias("k"), "target", F.round(n / (F.size("ta") + F.size("tb") - n), 9).alias("sim")).filter(F.col("sim") >= t)
