"""Incremental jobs in Structured Streaming. Each runs over what is there and stops; a scheduler or a processing-time
trigger repeats it. Progress and state are in the checkpoint folder, so a restart repeats nothing and loses nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..operators import ingest
from ..operators.state import shared_dir


def stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A table's files as they come. The path is given as a pattern, as a plain one must be a folder, and a table may be
    one file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def run(df: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes what is there, batch by batch; ``each`` must be idempotent by its batch id."""
    at = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """The stream's rows, written batch by batch; a repeated batch replaces itself."""
    spark = df.sparkSession
    run(df, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}"), mode)
    return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)


def ingest_pages(pages: DataFrame, path: str, near: float | None = None, chunks: Callable[[Column], Column] = ingest.boundary_chunks) -> DataFrame:
    """Pages (page_id, domain, content, and embedding if ``near`` is given) as they come: known domain, secrets masked, cut to
    length, hashed, deduplicated against all that was stored before, chunked, and, with ``near``, closing the nearest open
    page of their domain. Returns (page_id, domain, content_hash, redactions, content); the chunks are at ``path``/chunks,
    what closes what at ``path``/closed. A batch writes folders of its own number, so a repeated batch replaces itself."""
    spark = pages.sparkSession
    kept = "page_id long, domain string, content_hash string, redactions int, content string" + ", embedding array<float>" * (near is not None)
    closed = "page_id long, superseded_by long"

    def table(name: str, schema: str, batches: range) -> DataFrame:
        at = [f"{path}/{name}/batch={b}" for b in batches]
        return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)

    def each(rows: DataFrame, batch: int) -> None:
        stored = table("pages", kept, range(batch))
        one = ingest.prepare(rows).select(*[c.split()[0] for c in kept.split(", ")])
        ingest.exact_dedup(one, stored, ["domain"], ["page_id"]).write.mode("overwrite").parquet(f"{path}/pages/batch={batch}")
        new = table("pages", kept, range(batch, batch + 1))
        new.select("page_id", F.inline(chunks(F.col("content")))).write.mode("overwrite").parquet(f"{path}/chunks/batch={batch}")
        if near is not None:
            gone = table("closed", closed, range(batch))
            open_ = stored.join(gone, "page_id", "left_anti")
            vectors = new.filter("embedding IS NOT NULL").withColumn("seq", F.col("page_id"))
            ingest.closings(vectors, ["domain"], near, open_).write.mode("overwrite").parquet(f"{path}/closed/batch={batch}")

    run(pages, each)
    return spark.read.schema(kept).option("recursiveFileLookup", True).parquet(f"{path}/pages")


def cursors(events: DataFrame) -> DataFrame:
    """Per organization the latest (ts, event_id) seen, which only moves forward, and how many rows moved it past. A batch's
    rows of a group come in any order and in pieces, so all are counted against where the batch began."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, n = state.get if state.exists else (0, -1, 0)
        top = (at, last)
        for b in batches:
            later = b[(b["at"] > at) | ((b["at"] == at) & (b["event_id"] > last))]
            n += len(later)
            if len(later):
                most = later.sort_values(["at", "event_id"]).iloc[-1]
                top = max(top, (int(most["at"]), int(most["event_id"])))
        state.update((*top, n))
        yield pd.DataFrame({"organization_id": [key[0]], "at": [top[0]], "event_id": [top[1]], "n": [n]})

    out = "organization_id long, at long, event_id long, n long"
    return events.groupBy("organization_id").applyInPandasWithState(step, out, "at long, event_id long, n long", "update", GroupStateTimeout.NoTimeout)


class ThinkStripper:
    """Removes <think> blocks from a text that comes in pieces, whatever a piece cuts through."""

    OPEN, CLOSE = "<think>", "</think>"

    def __init__(self) -> None:
        self.held, self.inside = "", False

    def feed(self, piece: str) -> str:
        self.held += piece
        out = []
        while True:
            mark = self.CLOSE if self.inside else self.OPEN
            at = self.held.find(mark)
            if at >= 0:
                out.append("" if self.inside else self.held[:at])
                self.held, self.inside = self.held[at + len(mark) :], not self.inside
                continue
            # what may be the start of a mark waits for the next piece
            keep = next((k for k in range(min(len(mark) - 1, len(self.held)), 0, -1) if mark.startswith(self.held[-k:])), 0)
            free = self.held[: len(self.held) - keep]
            self.held = self.held[len(self.held) - keep :]
            return "".join([*out, "" if self.inside else free])

    def close(self) -> str:
        return "" if self.inside else self.held


def strip_streams(pieces: DataFrame) -> DataFrame:
    """A stream of texts in pieces (stream_id, seq, piece, last) without their <think> blocks: (stream_id, seq, text) of what
    is free after each batch. What is held back, and whether a block is open, is the text's state; it goes with its last piece."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = ThinkStripper()
        if state.exists:
            s.held, s.inside = state.get
        rows = pd.concat(list(batches)).sort_values("seq")
        out = "".join(s.feed(x) for x in rows["piece"])
        if rows["last"].any():
            out += s.close()
            if state.exists:
                state.remove()
        else:
            state.update((s.held, s.inside))
        yield pd.DataFrame({"stream_id": [key[0]], "seq": [int(rows["seq"].iloc[0])], "text": [out]})

    return pieces.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seq long, text string", "held string, inside boolean", "append", GroupStateTimeout.NoTimeout)


def embed_pending(chunks: DataFrame, path: str, embed) -> DataFrame:
    """Chunks (chunk_id, content) as they come, with vectors from a plug-in (``functions.models.embedder``)."""
    return to_table(chunks.select("chunk_id", embed(F.col("content")).alias("embedding")), path)
