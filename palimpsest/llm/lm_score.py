"""LM scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens are the words of a text, A-Z lower-cased, and one end. The model predicts a token from the ``CONTEXT`` tokens before
it: the context's vectors, each scaled by its position's weights, add up to a prediction. Its products with the classes'
vectors, and a bias each, are normalised over the classes, then its products with the words of the token's class over that
class: two levels, so that ``OWN`` words have probabilities of their own. These are the commonest words, in classes by rank.
All other words share ``TAILS`` classes, one for each of the commonest endings among them and one for the rest; within such a
class a word has probability (c + 1) / (N + V + 1), with c, N, V the word's count and the class's training tokens and words:
one share is left for all words never seen.

Counts are over all training documents. So is the training: documents are dealt to shards of about ``SHARD_TOKENS`` tokens by
a hash of doc_id and text, each shard is passed over once in the order of a hash, from the same start, and the models are
averaged by their tokens. So the result depends on the documents, not on how files or partitions hold them. Noise is drawn
from the shares of classes, and of words within a class. Scores are exact sums over whole texts: words of the broadcast head
(a bounded number) are looked up in Python, all others are joined with the whole table of counts.

Nulls are empty texts, which are one end token. Rows are scored one by one, also where doc_ids repeat; a null doc_id
counts as the empty text for the split. Without any training text all counts are 0, and the model is uniform over its
classes. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import cut_round
from .common import crc_bucket, cut, map_rows

OWN, PER_CLASS, TAILS, DIM, CONTEXT = 2048, 32, 64, 16, 4
CLASSES = OWN // PER_CLASS
#: What the context is made of: own words, then shared classes. What the first level predicts: classes, then shared ones.
UNITS, FIRST = OWN + TAILS, CLASSES + TAILS
#: Words, at most, whose counts every worker has.
HEAD = 131_072
NOISE, SAMPLES, WORD_NOISE, BATCH, RATE = 16, 64, 4, 4096, 0.02
SHARD_TOKENS = 4_000_000
#: Tasks that train at most, each a number of shards, and tasks whose models are summed by one.
TASKS, GROUP = 1024, 32
HELD_OUT, BUCKETS = 2, 7
#: Distinct words that a worker counts before it hands them on.
COUNTED = 200_000
END = b""  # no word is empty


def held_out():
    return crc_bucket("doc_id", BUCKETS) == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c) over all ``docs``; the end has the empty word."""

    def make():
        class Words:
            def __init__(self):
                self.counts = Counter()

            def __call__(self, cols):
                for text in cols[0]:
                    self.counts.update(tokens(text))
                    if len(self.counts) > COUNTED:
                        yield from self.finish()

            def finish(self):
                yield [list(self.counts.keys()), list(self.counts.values())]
                self.counts = Counter()

        return Words()

    return map_rows(docs, ["text"], "word binary, c long", make).groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Units, and tables by a word's number: its place in the head, or the head's size and its shared class.

    head: the commonest words with their counts, in order; endings: tokens and words by the last two bytes of a word."""

    def __init__(self, head: list[tuple[bytes, int]], endings: dict[bytes, tuple[int, int]], total: int, distinct: int):
        counts = dict(head)
        own = {END: 0} | {w: i + 1 for i, (w, _) in enumerate([x for x in head if x[0] != END][: OWN - 1])}
        rest = {e: list(x) for e, x in endings.items()}
        for w in own:
            if w != END:
                rest[w[-2:]][0] -= counts[w]
                rest[w[-2:]][1] -= 1
        common = sorted((e for e, x in rest.items() if x[1] > 0), key=lambda e: (-rest[e][0], e))[: TAILS - 1]
        #: The shared class of an ending; 0 is that of all others.
        self.endings = {e: t + 1 for t, e in enumerate(common)}
        self.total, self.distinct = total, distinct
        tokens, words_in = np.zeros(TAILS), np.zeros(TAILS)
        for e, (n, v) in rest.items():
            tokens[self.endings.get(e, 0)] += n
            words_in[self.endings.get(e, 0)] += v
        norm = np.log10(tokens + words_in + 1)
        mass = np.ones(OWN)
        for w, i in own.items():
            mass[i] += counts.get(w, 0)
        #: Shares of own words within their classes, and of classes.
        self.within = (mass.reshape(CLASSES, PER_CLASS) / mass.reshape(CLASSES, PER_CLASS).sum(1, keepdims=True)).ravel()
        first = np.r_[mass.reshape(CLASSES, PER_CLASS).sum(1), tokens + 1]
        self.share = first / first.sum()
        words = list(counts | dict.fromkeys(own, 0) if END not in counts else counts)
        self.number = {w: i for i, w in enumerate(words)}
        self.head = len(words)
        self.unit_of = np.array([*[own[w] if w in own else OWN + self.tail_of(w) for w in words], *range(OWN, UNITS)], np.uint16)
        c = np.array([counts.get(w, 0) for w in words] + [0] * TAILS)
        self.known = (c > 0).astype(np.int64)
        #: What a word adds to the base score, and, beyond its unit's probability, to the model's.
        self.base = np.log10(c + 1.0)
        tail = np.maximum(self.unit_of.astype(np.int64) - OWN, 0)
        self.inner = np.where(self.unit_of >= OWN, self.base - norm[tail], 0)

    def tail_of(self, word: bytes) -> int:
        return self.endings.get(word[-2:], 0)


class Lookup(dict):
    """Numbers of words; those beyond the head are learnt as they come."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.number)
        self.first, self.vocabulary = vocabulary.head, vocabulary
        self.limit = len(self) + 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.limit:
            self.clear()
            self.update(self.vocabulary.number)
        out = self[word] = self.first + self.vocabulary.tail_of(word)
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def class_of(units: np.ndarray) -> np.ndarray:
    """What the first level predicts for a unit."""
    units = units.astype(np.int64)
    return np.where(units < OWN, units // PER_CLASS, units - OWN + CLASSES)


class LogBilinear:
    def __init__(self, share: np.ndarray, within: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "context": rng.normal(0, 0.1, (UNITS, DIM)).astype(np.float32),
            "position": np.full((CONTEXT, DIM), 1 / CONTEXT, np.float32),
            "class": rng.normal(0, 0.1, (FIRST, DIM)).astype(np.float32),
            "word": rng.normal(0, 0.1, (OWN, DIM)).astype(np.float32),
            "class_bias": np.log(share).astype(np.float32),
            "word_bias": np.log(within).astype(np.float32),
        }
        self.share = share
        self.class_noise = np.log(NOISE * share).astype(np.float32)
        self.word_noise = np.log(WORD_NOISE * within).astype(np.float32)
        #: For draws within a class by one cell each: what a cell keeps for its own word, and whose the rest is (alias method).
        self.keep, self.rest = _alias(within)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, v in self.p.items():
            out[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return out

    def load(self, flat: np.ndarray) -> LogBilinear:
        self.p = self._views(np.asarray(flat, np.float32))
        return self

    @staticmethod
    def windows(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The CONTEXT units before each token of texts laid end to end; ends (unit 0) stand before a text."""
        place = np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.zeros((CONTEXT, len(units)), np.int32)
        for k in range(1, CONTEXT + 1):
            out[k - 1, k:] = units[:-k]
            out[k - 1][place < k] = 0
        return out

    def noise_words(self, classes: np.ndarray, rng) -> np.ndarray:
        """WORD_NOISE words of each of the classes, by their shares."""
        place = rng.random((len(classes), WORD_NOISE)) * PER_CLASS
        cell = place.astype(np.int64)
        place -= cell
        cell += (classes * PER_CLASS)[:, None]
        return np.where(place < self.keep.take(cell), cell, self.rest.take(cell))

    def train(self, target: np.ndarray, before: np.ndarray, state: dict, rng) -> None:
        """Noise-contrastive estimation on both levels. A batch's class noise is shared and counts as NOISE draws for every
        target; each own word has WORD_NOISE words of its class against it."""
        flat = self.flat()
        self.load(flat)  # from here the parameters are views of one vector
        grad = np.zeros_like(flat)
        g = self._views(grad)
        m, s = state.setdefault("m", np.zeros_like(flat)), state.setdefault("s", np.zeros_like(flat))
        p = self.p
        classes = class_of(target)
        draws_of = rng.choice(FIRST, (-(-len(target) // BATCH), SAMPLES), p=self.share)
        for b, a in enumerate(range(0, len(target), BATCH)):
            w, y, ctx, draws = target[a : a + BATCH], classes[a : a + BATCH], before[:, a : a + BATCH].astype(np.intp), draws_of[b]
            n = len(y)
            rows = p["context"].take(ctx, axis=0)
            q = rows[0] * p["position"][0]
            for k in range(1, CONTEXT):
                q += rows[k] * p["position"][k]
            lift = p["class_bias"] - self.class_noise
            other, mine = p["class"][draws], p["class"].take(y, axis=0)
            dd = -1 / n / (1 + np.exp(np.minimum(np.einsum("nd,nd->n", q, mine) + lift[y], 30)))
            dn = q @ other.T
            dn += lift[draws]
            np.negative(dn, out=dn)
            np.exp(np.minimum(dn, 30, out=dn), out=dn)
            dn += 1
            np.divide(NOISE / SAMPLES / n, dn, out=dn)
            dq = dn @ other
            mine *= dd[:, None]
            dq += mine
            _sums(g["class"], y, (dd[:, None] * q).T)
            np.add.at(g["class"], draws, dn.T @ q)
            g["class_bias"][:] = np.bincount(y, dd, FIRST)
            np.add.at(g["class_bias"], draws, dn.sum(0))
            own = np.flatnonzero(w < OWN)
            x, qo = w[own].astype(np.int64), q[own]
            both = np.concatenate([x[:, None], self.noise_words(y[own], rng)], axis=1)
            vectors = p["word"].take(both, axis=0)
            z = np.einsum("nkd,nd->nk", vectors, qo)
            z += (p["word_bias"] - self.word_noise).take(both)
            z[:, 0] *= -1
            d = (1 / n) / (1 + np.exp(np.minimum(-z, 30)))
            d[:, 0] *= -1
            dq[own] += np.einsum("nk,nkd->nd", d, vectors)
            # by word, all that were drawn with a column of their own
            qt = np.ascontiguousarray(qo.T)
            _sums(g["word"], both.T.ravel(), (np.ascontiguousarray(d.T)[None, :, :] * qt[:, None, :]).reshape(DIM, -1))
            g["word_bias"][:] = np.bincount(both.ravel(), d.ravel(), OWN)
            for k in range(CONTEXT):
                g["position"][k] = np.einsum("nd,nd->d", rows[k], dq)
            # a position's weights are the same for all of its words, so they come after the sums
            dt = dq.T.astype(np.float64, order="C")
            sums = np.array([_lines(ctx[k], dt, UNITS) for k in range(CONTEXT)])
            g["context"][:] = np.einsum("kdu,kd->ud", sums, p["position"])
            state["n"] = step = state.get("n", 0) + 1
            m *= 0.9
            m += 0.1 * grad
            s *= 0.99
            np.multiply(grad, grad, out=grad)
            grad *= 0.01
            s += grad
            np.sqrt(s, out=grad)
            grad *= 1 / math.sqrt(1 - 0.99**step)
            grad += 1e-7
            np.divide(m, grad, out=grad)
            grad *= RATE / (1 - 0.9**step)
            flat -= grad

    def log10(self, target: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the target units."""
        p = self.p
        tables = [p["context"] * w for w in p["position"]]
        across = np.ascontiguousarray(p["class"].T)
        words = np.ascontiguousarray(p["word"].reshape(CLASSES, PER_CLASS, DIM).transpose(0, 2, 1))
        bias = p["word_bias"].reshape(CLASSES, PER_CLASS)
        classes, out = class_of(target), np.empty(len(target), np.float64)
        asked = np.empty((len(target), DIM), np.float32)
        for a in range(0, len(target), 4096):
            ctx, q = before[:, a : a + 4096], asked[a : a + 4096]
            np.take(tables[0], ctx[0], axis=0, out=q)
            for k in range(1, CONTEXT):
                q += tables[k].take(ctx[k], axis=0)
            z = q @ across
            z += p["class_bias"]
            out[a : a + 4096] = _log_softmax(z, classes[a : a + 4096])
        # then all tokens of a class at once
        order = np.argsort(classes.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[c] : cuts[c + 1]]
            z = asked.take(own, axis=0) @ words[c]
            z += bias[c]
            out[own] += _log_softmax(z, target[own].astype(np.int64) - c * PER_CLASS)
        return out / math.log(10)


def _alias(within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keep, rest) of each own word: of PER_CLASS equal cells each keeps a share for its word, the rest is one other word's."""
    left, rest = (within * PER_CLASS).tolist(), list(range(OWN))
    keep = [1.0] * OWN
    for c in range(0, OWN, PER_CLASS):
        low = [i for i in range(c, c + PER_CLASS) if left[i] < 1]
        high = [i for i in range(c, c + PER_CLASS) if left[i] >= 1]
        while low and high:
            i, j = low.pop(), high[-1]
            keep[i], rest[i] = left[i], j
            left[j] -= 1 - left[i]
            if left[j] < 1:
                low.append(high.pop())
    return np.array(keep), np.array(rest)


def _sums(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Values (a line for each dimension) added up by row."""
    into[:] = _lines(rows, values, len(into)).T


def _lines(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.array([np.bincount(rows, line, n) for line in values])


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = z.ravel().take(np.arange(0, z.size, z.shape[1]) + at).astype(np.float64)
    with np.errstate(over="ignore"):
        sums = np.exp(z) @ np.ones(z.shape[1], np.float32)
    if np.isfinite(sums).all() and sums.all():
        return own - np.log(sums)
    # beyond what a float holds
    top = z.max(axis=1, keepdims=True)
    return own - top[:, 0] - np.log(np.exp(z - top).sum(1))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """About the ``most`` commonest words (word, c), by count. Counts are sorted into bins, a few thousand at most; whole bins
    are taken, and of the first that doesn't fit as many words, by a hash, as there is room for."""
    level = F.floor(F.log2("c") * 64)
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    room, chosen = most, F.lit(True)
    for r in bins:
        if r.n > room:
            chosen = (level > r.level) | ((level == r.level) & (F.crc32("word") < int(2**32 * room / r.n)))
            break
        room -= r.n
    rows = counts.filter(chosen).collect()
    return sorted(((bytes(r.word), r.c) for r in rows), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """(counts, vocabulary, parameters) from ``docs``, all of which are for training."""
    counts = cut(count_tokens(docs))
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    # two bytes have 65,792 values, so that is all that comes here
    ending = F.when(F.octet_length("word") >= 2, F.substring("word", -2, 2)).otherwise(F.col("word"))
    per = counts.filter(F.octet_length("word") > 0).groupBy(ending.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    vocabulary = Vocabulary(commonest(counts, HEAD), {bytes(r.e): (r.n, r.v) for r in per}, int(total or 0), int(distinct or 0))
    return counts, vocabulary, _train(docs, vocabulary)


def _train(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    shards = max(1, -(-vocabulary.total // SHARD_TOKENS))
    place = F.xxhash64(F.col("doc_id").cast("string"), "text")

    def to_units():
        look, unit_of = Lookup(sent.value), sent.value.unit_of

        def f(cols):
            yield [cols[0], cols[1], [unit_of[look.numbers(tokens(t))].tobytes() for t in cols[2]]]

        return f

    def make():
        class Shards:
            shard, model, total, tokens = None, None, 0.0, 0

            def close(self):
                """Adds the shard's model to the task's sum."""
                if self.model is not None:
                    if self.held:
                        self.learn()
                    self.total = self.total + self.model.flat().astype(np.float64) * self.n
                    self.tokens += self.n

            def learn(self):
                target = np.concatenate(self.held)
                before = LogBilinear.windows(target, np.array([len(x) for x in self.held]))
                order = self.rng.permutation(len(target))
                self.model.train(target[order], before[:, order], self.state, self.rng)
                self.n += len(target)
                self.held, self.size = [], 0

            def __call__(self, cols):
                for shard, raw in zip(cols[0], cols[1], strict=True):
                    if shard != self.shard:
                        self.close()
                        self.shard, self.model = shard, LogBilinear(sent.value.share, sent.value.within)
                        self.state, self.rng, self.n, self.held, self.size = {}, np.random.default_rng(3), 0, [], 0
                    self.held.append(np.frombuffer(raw, np.uint16))
                    self.size += len(self.held[-1])
                    if self.size > 200_000:
                        self.learn()
                return iter(())

            def finish(self):
                self.close()
                if self.tokens:
                    yield [[self.total.tobytes()], [self.tokens]]

        return Shards()

    rows = map_rows(docs.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("h"), "text"), ["shard", "h", "text"], "shard int, h long, units binary", to_units)
    parts = min(shards, TASKS)
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", "h")
    # a sum of models for each task, then for each of their groups: what comes to the driver doesn't grow with the corpus
    sums = map_rows(dealt, ["shard", "units"], "model binary, n long", make)
    few = cut_round(map_rows(sums.repartition(-(-parts // GROUP)), ["model", "n"], "model binary, n long", _added)).collect()
    if not few:
        return LogBilinear(vocabulary.share, vocabulary.within).flat()
    return sum(np.frombuffer(r.model) for r in few) / sum(r.n for r in few)


def _added():
    class Sum:
        total, n = 0.0, 0

        def __call__(self, cols):
            for model, n in zip(*cols, strict=True):
                self.total = self.total + np.frombuffer(model)
                self.n += n
            return iter(())

        def finish(self):
            if self.n:
                yield [[self.total.tobytes()], [self.n]]

    return Sum()


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, flat: np.ndarray) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))

    def make():
        from pyspark import TaskContext

        v, p = sent.value
        look, model = Lookup(v), LogBilinear(v.share, v.within).load(p)
        state = {"uid": TaskContext.get().partitionId() << 40}

        def f(cols):
            for a in range(0, len(cols[0]), 256):
                ids, texts = (c[a : a + 256] for c in cols)
                words = [tokens(t) for t in texts]
                sizes = np.array([len(w) for w in words])
                flat = list(chain.from_iterable(words))
                number = look.numbers(flat)
                target = v.unit_of[number]
                starts = np.cumsum(sizes) - sizes
                total = lambda x, s=starts: np.add.reduceat(x, s).tolist()
                model_sums = total(model.log10(target, LogBilinear.windows(target, sizes)) + v.inner[number])
                uids = np.arange(len(words)) + state["uid"]
                state["uid"] += len(words)
                # a space is in no word, so these rows meet no count
                yield [uids, ids, [b" %d" % u for u in uids.tolist()], sizes, total(v.known[number]), total(v.base[number]), model_sums]
                beyond = np.flatnonzero(number >= v.head)
                if len(beyond):
                    far = list(map(flat.__getitem__, beyond.tolist()))
                    place = {w: i for i, w in enumerate(dict.fromkeys(far))}
                    own = (np.searchsorted(starts, beyond, "right") - 1) * len(place)
                    pair, times = np.unique(own + np.fromiter(map(place.__getitem__, far), np.int64, len(far)), return_counts=True)
                    n = len(pair)
                    named = pa.array(list(place), pa.binary()).take(pa.array(pair % len(place)))
                    yield [uids[pair // len(place)], pa.nulls(n, pa.int64()), named, times, np.full(n, -1), np.zeros(n), np.zeros(n)]

        return f

    rows = map_rows(docs, ["doc_id", "text"], "uid long, doc_id long, word binary, n long, known long, base double, model double", make)
    met = rows.join(counts, "word", "left")
    tail = F.col("known") < 0
    log_c = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    sums = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum(F.when(tail, 0).otherwise(F.col("n"))).alias("n_tokens"),
        F.sum(F.when(tail, F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).otherwise(F.col("known"))).alias("n_known"),
        F.sum(F.when(tail, log_c).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(tail, log_c).otherwise(F.col("model"))).alias("score"),
    )
    each = math.log10(vocabulary.total + vocabulary.distinct + 1)
    return sums.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * each).alias("base_score"), "score")


def score_all(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out, scores all."""
    return score(docs, *fit(docs.filter(~held_out())))
