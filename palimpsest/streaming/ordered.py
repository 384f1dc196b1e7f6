"""Streams that are judged in the order of their events, however they are cut into files and batches.

Rows of a key wait in its shard's state until the watermark has passed them, so that whatever was to come before them has come; then a
timer wakes the shard and a judge walks each key's in the order of (ts, event_id). A judge can also set a deadline, which falls due by the
watermark when nothing more comes. A row that comes after a later one of its key was judged is given out as late, with no verdict: nothing is dropped.
State lives in the state store and the checkpoint, so a restart goes on where the last run ended.

A finite stream can be closed: a mark with a time beyond all others moves the watermark past what still waits."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, event_id long, us long, what string, since long, verdict boolean"
#: Beyond all events.
END = datetime(2200, 1, 1)
END_US = 1 << 62
#: Keys are walked in so many shards. Microseconds of a slice of what waits. Rows that are put into the state, or given out, at a time.
SHARDS, SLICE, FLUSH = 1024, 86_400_000_000, 100_000


class Judge:
    """What is known of a key is a row of ``state`` (null: nothing yet). ``step`` takes one event; ``due`` is a time in microseconds
    at which, if nothing comes before, ``expire`` is called. Both give (state, [(what, since, verdict)]) for the event."""

    state = "level double, since long, told boolean"

    def step(self, known: tuple | None, us: int, flag: bool | None) -> tuple[tuple, list]:
        raise NotImplementedError

    def due(self, known: tuple | None) -> int | None:
        return None

    def expire(self, known: tuple, us: int) -> tuple[tuple, list]:
        raise NotImplementedError


class Bucket(Judge):
    """Requests admitted by a bucket of per_minute / 2 + 1 tokens, refilled steadily."""

    def __init__(self, per_minute: int):
        self.burst, self.rate = per_minute // 2 + 1, per_minute / 60e6

    def step(self, known, us, flag):
        level = float(self.burst) if known is None else min(self.burst, known[0] + (us - known[1]) * self.rate)
        admitted = level >= 1
        return (float(level - admitted), us, False), [("judged", None, admitted)]


class Grace(Judge):
    """Since when a key is over without a break, and whether that is longer than the grace. When the grace ends with nothing heard
    that breaks it, that is told once."""

    def __init__(self, hours: int):
        self.grace = hours * 3_600_000_000

    def step(self, known, us, flag):
        since, told = (known[1], known[2]) if known else (None, False)
        since = (us if since is None else since) if flag else None
        blocked = since is not None and us - since > self.grace
        return (0.0, since, bool(told and since is not None)), [("judged", since, blocked)]

    def due(self, known):
        return None if known is None or known[1] is None or known[2] else known[1] + self.grace + 1

    def expire(self, known, us):
        return (0.0, known[1], True), [("timer", known[1], True)]


class Once(Judge):
    """A job is let through if the last of its key that was lies ``seconds`` back or more."""

    def __init__(self, seconds: int):
        self.delay = seconds * 1_000_000

    def step(self, known, us, flag):
        new = known is None or us - known[1] >= self.delay
        return (0.0, us if new else known[1], False), [("judged", None, new)]


class Expiry(Judge):
    """Something that is opened (flag) and neither opened again nor closed within ``seconds`` expires."""

    def __init__(self, seconds: int):
        self.ttl = seconds * 1_000_000

    def step(self, known, us, flag):
        return (0.0, us if flag else None, False), [("judged", known[1] if known and not known[2] else None, bool(flag))]

    def due(self, known):
        return None if known is None or known[1] is None or known[2] else known[1] + self.ttl

    def expire(self, known, us):
        return (0.0, known[1], True), [("expired", known[1], False)]


class InOrder(StatefulProcessor):
    """Walks a shard of keys. What waits lies in the state in parts by the time of its events (``SLICE``), as arrays, so that a
    shard's rows of one slice are what a worker has at a time, and neither a key nor a row costs calls to the state of its own."""

    def __init__(self, judge: Judge):
        self.judge = judge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, part long", "rows binary")
        #: Pickled: by key what is known and the last event that was judged; by slice its first part, the next one and the first time;
        #: and the timer that is set, in milliseconds.
        self.book = handle.getValueState("book", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys, slices, timer = self._book()
        held, n = [], 0
        for batch in rows:
            if keys:
                last = [known[1] if (known := keys.get(k)) else None for k in batch["key"]]
                late = np.array([x is not None and (us, event) <= x for x, us, event in zip(last, batch["us"], batch["event_id"], strict=True)], dtype=bool)
                if late.any():
                    gone = batch[late]
                    yield self._out([(k, e, us, "late", None, None) for k, e, us in zip(gone["key"], gone["event_id"].tolist(), gone["us"].tolist(), strict=True)])
                    batch = batch[~late]
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= FLUSH:
                self._wait(pd.concat(held), slices)
                held, n = [], 0
        if n:
            self._wait(pd.concat(held), slices)
        self._keep(keys, slices, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        keys, slices, _ = self._book()
        out = []

        def expire(k, known: tuple | None, until: int) -> tuple | None:
            while (due := self.judge.due(known)) is not None and due < until:
                known, said = self.judge.expire(known, due)
                out.extend((k, -1, due, *x) for x in said)
            return known

        for s in sorted(slices):
            if s * SLICE >= passed:
                break
            names, code, us, event, flag = self._take(s, slices)
            now = us < passed
            rest = ~now
            if rest.any():
                self._put(s, names, code[rest], us[rest], event[rest], flag[rest], slices)
            order = np.flatnonzero(now)
            order = order[np.lexsort((flag[order], event[order], us[order], code[order]))]
            for c, at, e, f in zip(code[order].tolist(), us[order].tolist(), event[order].tolist(), flag[order].tolist(), strict=True):
                k = names[c]
                known, _ = keys.get(k, (None, None))
                known, said = self.judge.step(expire(k, known, at), at, None if f < 0 else bool(f))
                keys[k] = known, (at, e)
                out.extend((k, e, at, *x) for x in said)
                if len(out) >= FLUSH:
                    yield self._out(out)
                    out.clear()
        for k, (known, last) in keys.items():
            keys[k] = expire(k, known, passed), last
        self._keep(keys, slices, None)
        if out:
            yield self._out(out)

    def _book(self) -> tuple[dict, dict, int | None]:
        return pickle.loads(self.book.get()[0]) if self.book.exists() else ({}, {}, None)

    def _keep(self, keys: dict, slices: dict, timer: int | None) -> None:
        """Writes the book and sets the shard's one timer to just beyond the first time that waits or falls due, unless it rings before."""
        first = [x for _, _, x in slices.values()] + [x for known, _ in keys.values() if (x := self.judge.due(known)) is not None]
        want = min(first) // 1000 + 1 if first else None
        if timer is not None and want is not None and timer <= want:
            want = timer
        elif want is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(want)
        self.book.update((pickle.dumps((keys, slices, want), 5),))

    def _wait(self, rows: pd.DataFrame, slices: dict) -> None:
        code, names = pd.factorize(rows["key"], use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names]
        us, event = (rows[c].to_numpy(dtype=np.int64) for c in ("us", "event_id"))
        flag = np.array([-1 if f is None or pd.isna(f) else int(f) for f in rows["flag"]], dtype=np.int8)
        s = us // SLICE
        for one in np.unique(s).tolist():
            at = s == one
            self._put(one, names, code[at], us[at], event[at], flag[at], slices)

    def _put(self, s: int, names: list, code, us, event, flag, slices: dict) -> None:
        used, code = np.unique(code, return_inverse=True)
        low, high, first = slices.get(s, (0, 0, END_US))
        self.waiting.updateValue((s, high), (pickle.dumps(([names[c] for c in used], code.astype(np.int32), us, event, flag), 5),))
        slices[s] = low, high + 1, min(first, int(us.min()))

    def _take(self, s: int, slices: dict) -> tuple:
        """All that waits of a slice, which is then no more: (keys, and of each row its key's place there, time, event, flag)."""
        low, high, _ = slices.pop(s)
        place, parts = {}, []
        for part in range(low, high):
            names, code, *values = pickle.loads(self.waiting.getValue((s, part))[0])
            self.waiting.removeKey((s, part))
            own = np.array([place.setdefault(k, len(place)) for k in names], dtype=np.int32)
            parts.append((own[code], *values))
        return list(place), *(np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        key, event, us, what, since, verdict = zip(*rows, strict=True)
        return pd.DataFrame({"key": key, "event_id": event, "us": us, "what": what, "since": pd.array(since, "Int64"), "verdict": pd.array(verdict, "boolean")})

    def close(self) -> None:
        pass


def judged(events: DataFrame, judge: Judge, delay: str, path: str, close: bool = True) -> DataFrame:
    """What ``judge`` says of a stream of events (key, event_id, ts, flag), whose rows come at most ``delay`` after later ones:
    (key, event_id, us, what, since, verdict), what is judged, late, or the judge's own for a deadline (event_id -1). Runs over what
    is there; called again with the same ``path`` it goes on. With ``close`` all that still waits is judged too, and the stream ends."""
    spark = events.sparkSession
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("flag").cast("boolean").alias("flag"))
    marks = f"{path}/end"
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(marks)
    name = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name)

    def go() -> None:
        every = rows.unionByName(spark.readStream.schema(rows.schema).parquet(marks)).withWatermark("ts", delay)
        # without ts itself the engine drops no late rows: they are told apart by what was judged
        narrow = every.select(F.pmod(F.xxhash64("key"), F.lit(SHARDS)).alias("shard"), "key", "event_id", F.unix_micros("ts").alias("us"), "flag")
        out = narrow.groupBy("shard").transformWithStateInPandas(InOrder(judge), OUT, "Append", "EventTime")
        write = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")
        out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    spark.conf.set(name, ROCKS)
    try:
        go()
        if close:
            spark.createDataFrame([(None, -1, END, None)], rows.schema).coalesce(1).write.mode("append").parquet(marks)
            go()
    finally:
        spark.conf.set(name, had)
    # the mark itself has no key
    return spark.read.schema(OUT).option("recursiveFileLookup", True).parquet(f"{path}/out").filter("key IS NOT NULL")

