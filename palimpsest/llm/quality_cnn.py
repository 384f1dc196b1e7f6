"""Quality classifier: a byte-level convolutional network in numpy.

Filters over ``WIDTH`` bytes are slid over the whole text. Chunks of ``SEGMENT * SEGMENTS`` bytes, each overlapping the
next by a segment, are max-pooled; the mean and the maximum over all chunks and the text's length go through a hidden
layer to one probability. A filter is a table of weights by tap and byte, so a convolution is a sum of table rows; two
taps share a table of byte pairs.

The network learns from at most ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_BYTES`` in all, those first by a
hash of their id among all that are not held out; every document is scored whole.

Null and empty texts are one empty chunk and get a score too. Rows with null labels are not learnt from; without both
labels, or if of one no text fits the sample, every score is the share of label 1 (0.5 without labels). Rows are scored one by one, so repeated rows have equal
scores. A document with two labels is learnt with both. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, in_arrow, map_rows

WIDTH, FILTERS, HIDDEN = 6, 16, 16
SEGMENT, SEGMENTS = 64, 8
TRAIN_DOCS, TRAIN_BYTES = 2000, 6_000_000
STEPS, BATCH, RATE = 500, 40, 0.01
HELD_OUT, BUCKETS = 1, 3
#: Bytes that are convolved at a time: their activations, half a MB, stay in a core's cache.
BLOCK = 1 << 13


class Texts:
    """Texts laid out one after the other, each followed by WIDTH zero bytes, with the segments and chunks of each."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        gap = bytes(WIDTH)
        self.bytes = np.frombuffer(b"".join(x + gap for x in raw) + gap, np.uint8)
        sizes = np.array([max(1, len(x)) for x in raw], np.int64)
        lengths = np.array([len(x) + WIDTH for x in raw], np.int64)
        starts = np.cumsum(lengths) - lengths
        self.length = np.log1p(sizes) / 10
        per = -(-sizes // SEGMENT)
        own = np.repeat(np.arange(len(raw)), per)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.seg_start = starts[own] + k * SEGMENT
        self.seg_stop = np.minimum(self.seg_start + SEGMENT, (starts + sizes)[own])
        # chunk j of a text is its segments from j * (SEGMENTS - 1), SEGMENTS of them
        chunks = np.maximum(1, -(-(per - 1) // (SEGMENTS - 1)))
        self.chunks = chunks
        doc = np.repeat(np.arange(len(raw)), chunks)
        j = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        first = (np.cumsum(per) - per)[doc] + j * (SEGMENTS - 1)
        self.chunk_segments = np.minimum(first[:, None] + np.arange(SEGMENTS)[None, :], (np.cumsum(per) - 1)[doc][:, None])
        self.chunk_start = np.cumsum(chunks) - chunks


def _by_row(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w``, added up in the same order for a row whatever rows stand beside it: equal texts have equal scores in any batch."""
    out = np.zeros((len(x), w.shape[1]), np.float32)
    for i in range(x.shape[1]):
        out += x[:, i : i + 1].astype(np.float32) * w[i]
    return out


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = 2 * FILTERS + 1
        self.p = {
            "taps": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "inner": rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)).astype(np.float32),
            "inner_bias": np.zeros(HIDDEN, np.float32),
            "outer": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
            "prior": np.zeros(1, np.float32),
        }
        self.pairs = None

    def compile(self) -> Network:
        """Tables of byte pairs, for scoring."""
        t = self.p["taps"]
        self.pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        return self

    def _activations(self, b: np.ndarray, start: int, stop: int) -> np.ndarray:
        if self.pairs is None:
            t = self.p["taps"]
            out = t[0][b[start:stop]]
            for k in range(1, WIDTH):
                out += t[k][b[start + k : stop + k]]
            return out
        own = b[start : stop + WIDTH].astype(np.uint16)
        code = own[:-1] << np.uint16(8) | own[1:]
        n = stop - start
        out = self.pairs[0].take(code[:n], axis=0)
        for k in range(1, WIDTH // 2):
            out += self.pairs[k].take(code[2 * k : 2 * k + n], axis=0)
        return out

    def pooled(self, x: Texts) -> np.ndarray:
        """The maximum of each filter in each segment."""
        out = np.empty((len(x.seg_start), FILTERS), np.float32)
        a = 0
        while a < len(out):
            z = max(a + 1, int(np.searchsorted(x.seg_stop, x.seg_start[a] + BLOCK, "right")))
            base = int(x.seg_start[a])
            act = self._activations(x.bytes, base, int(x.seg_stop[z - 1]))
            # between texts there are zero bytes, which belong to no segment: reduce over starts and stops, keep starts
            edges = np.stack([x.seg_start[a:z], x.seg_stop[a:z]], 1).ravel() - base
            edges[-1] = min(edges[-1], len(act) - 1)
            if z - a and edges[-1] <= edges[-2]:
                edges = edges[:-1]
            out[a:z] = np.maximum.reduceat(act, edges, axis=0)[::2] if len(edges) % 2 else np.maximum.reduceat(act, edges[:-1], axis=0)[::2]
            a = z
        return out

    def features(self, x: Texts, segments: np.ndarray):
        chunk = segments[x.chunk_segments]
        top = chunk.max(axis=1) + self.p["bias"]
        act = np.maximum(top, 0)
        mean = np.add.reduceat(act, x.chunk_start, axis=0) / x.chunks[:, None]
        high = np.maximum.reduceat(act, x.chunk_start, axis=0)
        return chunk, top, act, np.concatenate([mean, high, x.length[:, None]], axis=1).astype(np.float32)

    def head(self, z: np.ndarray):
        hidden = np.maximum(_by_row(z, self.p["inner"]) + self.p["inner_bias"], 0)
        return hidden, 1 / (1 + np.exp(-(_by_row(hidden, self.p["outer"][:, None])[:, 0] + self.p["prior"][0]).clip(-30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = Texts(texts)
        return self.head(self.features(x, self.pooled(x))[-1])[1]

    def gradients(self, x: Texts, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        segments = self.pooled(x)
        chunk, top, act, z = self.features(x, segments)
        hidden, prob = self.head(z)
        d = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"prior": np.array([d.sum()], np.float32), "outer": hidden.T @ d}
        dh = np.outer(d, self.p["outer"]) * (hidden > 0)
        g |= {"inner": z.T @ dh, "inner_bias": dh.sum(0)}
        dz = dh @ self.p["inner"].T
        doc = np.repeat(np.arange(len(y)), x.chunks)
        da = dz[doc, :FILTERS] / x.chunks[doc][:, None]
        best = np.maximum.reduceat(act, x.chunk_start, axis=0)
        is_best = act == best[doc]
        da += dz[doc, FILTERS : 2 * FILTERS] * is_best / np.add.reduceat(is_best, x.chunk_start, axis=0)[doc]
        da *= top > 0
        g["bias"] = da.sum(0)
        # only where the maximum stands do the filters learn
        seg = np.take_along_axis(x.chunk_segments, chunk.argmax(axis=1), axis=1)
        rows, cols = np.nonzero(da)
        want = seg[rows, cols]
        place = np.full(len(rows), -1, np.int64)
        step = np.arange(SEGMENT)
        for f in np.unique(cols).tolist():
            own = np.flatnonzero(cols == f)
            u, back = np.unique(want[own], return_inverse=True)
            at = np.minimum(x.seg_start[u][:, None] + step[None, :], x.seg_stop[u][:, None] - 1)
            value = sum(self.p["taps"][k, :, f][x.bytes[at + k]] for k in range(WIDTH))
            place[own] = at[np.arange(len(u)), value.argmax(axis=1)][back]
        taps = np.zeros(WIDTH * 256 * FILTERS, np.float32)
        for k in range(WIDTH):
            code = (k * 256 + x.bytes[place + k].astype(np.int64)) * FILTERS + cols
            taps += np.bincount(code, da[rows, cols], len(taps)).astype(np.float32)
        g["taps"] = taps.reshape(WIDTH, 256, FILTERS)
        return g


def train(texts: list[str], labels: list[int], seed: int = 11) -> Network:
    """Adam over batches with as many of each label."""
    net = Network(seed)
    y = np.array(labels, np.float32)
    groups = [np.flatnonzero(y == v) for v in (0, 1)]
    if not all(map(len, groups)):
        share = float(y.mean()) if len(y) else 0.5
        net.p["outer"][:] = 0
        net.p["prior"][0] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return net.compile()
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        own = np.concatenate([rng.choice(x, BATCH // 2) for x in groups])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in net.gradients(Texts([texts[i] for i in own]), y[own], np.ones(len(own))).items():
            m[k] += 0.1 * (g - m[k])
            s[k] += 0.01 * (g * g - s[k])
            net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return net.compile()


def held_out(column: str = "doc_id"):
    return crc_bucket(column, BUCKETS) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_bytes: int = TRAIN_BYTES) -> Network:
    """docs: doc_id, text; labels: doc_id, quality. Half of the sample has label 0 where there is enough of it.

    Each label has half of ``max_bytes``, and what the other leaves. Of texts that don't fit the longest are left out. A label
    of whose sample nothing fits gets another one, of documents that do; if none does, nothing is learnt but the labels' shares."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null").filter(~held_out()).distinct()
    order = F.xxhash64("doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    texts = docs.select("doc_id", "text", size.alias("n"))
    first = lambda ids: ids.orderBy(order, "doc_id").limit(max_docs // 2)
    half = lambda v: first(known.filter(F.col("y") == v))
    sampled = texts.join(F.broadcast(half(0).unionByName(half(1))), "doc_id")
    total = {r.y: r.n for r in sampled.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    room = {v: max(max_bytes // 2, max_bytes - total.get(1 - v, 0)) for v in (0, 1)}
    rows = _fitting(sampled, room, max_docs // 2)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    for v in counts.keys() - {r.y for r in rows}:
        every = docs.select("doc_id", size.alias("n")).join(known.filter(F.col("y") == v), "doc_id")
        others = first(every.filter(F.col("n") <= max_bytes // 2).select("doc_id", "y").distinct())
        rows += _fitting(texts.join(F.broadcast(others), "doc_id"), {v: max_bytes // 2}, max_docs // 2)
    net = train([r.text for r in rows], [r.y for r in rows])
    if counts.keys() == {0, 1}:
        if {r.y for r in rows} != {0, 1}:
            net.p["prior"][:] = 0
        # batches have both labels alike; all labels have their own shares
        net.p["prior"] += np.float32(np.log(counts[1] / counts[0]))
    return net


def _fitting(rows: DataFrame, room: dict[int, int], most: int) -> list:
    """(y, text), in the order of the ids' hashes: of each label the shortest, as many as have ``room`` bytes together and at
    most ``most``. Rows that are alike count once. What fits is decided without the texts, so a doc_id of any number of rows
    is no task of its own."""
    narrow = rows.select("doc_id", "y", "n", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("th"))
    wanted = []
    for v, limit in room.items():
        size = 0
        own = narrow.filter((F.col("y") == v) & (F.col("n") <= limit)).distinct().orderBy("n", "h", "doc_id", "th").limit(most).collect()
        for r in own:
            size += r.n
            if size > limit:
                break
            wanted.append((r.doc_id, r.y, r.th))
    if not wanted:
        return []
    few = F.broadcast(rows.sparkSession.createDataFrame(wanted, "doc_id long, y int, th long"))
    kept = rows.withColumn("th", F.xxhash64("text")).join(few, ["doc_id", "y", "th"]).dropDuplicates(["doc_id", "y", "th"])
    return sorted(kept.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", "text").collect(), key=lambda r: (r.h, r.doc_id, r.y, r.text or ""))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def make():
        own = Network()
        own.p = sent.value
        own.compile()

        def f(cols):
            yield [cols[0], own.score(cols[1]).astype(np.float64)]

        return f

    return map_rows(docs, ["doc_id", "text"], "doc_id long, score double", make)


def keep_good(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches):
        import pyarrow as pa

        own = Network()
        own.p = sent.value
        own.compile()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if texts:
                yield batch.filter(pa.array(own.score(texts) >= 0.5, pa.bool_()))

    return in_arrow(docs, run, docs.schema)
