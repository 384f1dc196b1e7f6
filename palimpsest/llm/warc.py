"""WARC archives of pages: a writer, and a sequential reader.

Every record is a gzip member of its own. The reader inflates a member step by step (``zlib.decompressobj``), takes the
block's length from Content-Length, and checks both digests; it holds one block and a bounded piece of the file.

Payloads are the html in UTF-8, null as empty. Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, that with
the smallest page_id is the response and the others are revisits, whose block is the response's HTTP head alone. Rows that
repeat the smallest page_id all are responses. Null page_ids are written, and are responses unless a page has the same
payload. Empty payloads are records too. A target URI is percent-encoded where a header could not hold it; null is left
out. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, file_system, lookup, map_rows, scratch

MIN_REVISIT = 100
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 128 << 20
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DamagedRecord(ValueError):
    pass


def _digest(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Refers-To", record_uri(refers_to)), ("WARC-Profile", PROFILE), ("WARC-Truncated", "length")]
    head += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + deflate.flush()


class Source:
    """The inflated bytes of a file, member by member."""

    def __init__(self, stream):
        self.stream, self.raw, self.ready, self.inflate = stream, b"", bytearray(), None

    def start(self) -> bool:
        """Opens the next member; false at the end of the file."""
        if not self.raw:
            self.raw = self.stream.read(PIECE)
        self.inflate, self.ready = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def more(self) -> bool:
        """Inflates a piece; false at the member's end."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(PIECE)
            if not self.raw:
                raise DamagedRecord("the file ends within a record")
        try:
            self.ready += self.inflate.decompress(self.raw, PIECE)
        except zlib.error as e:
            raise DamagedRecord(str(e)) from e
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def line(self) -> bytes:
        at = 0
        while (end := self.ready.find(b"\r\n", at)) < 0:
            at = max(0, len(self.ready) - 1)
            if not self.more():
                raise DamagedRecord("a header has no end")
        out = bytes(self.ready[:end])
        del self.ready[: end + 2]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise DamagedRecord("a block is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def _headers(next_line) -> dict[str, str]:
    out = {}
    while line := next_line():
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, verified."""
    source = Source(stream)
    while source.start():
        if not source.line().startswith(b"WARC/1."):
            raise DamagedRecord("a record doesn't start with its version")
        head = _headers(source.line)
        block = source.exactly(int(head["content-length"]))
        if source.exactly(4) != b"\r\n\r\n" or source.more() and source.ready:
            raise DamagedRecord("a record doesn't end after its block")
        while source.more():
            pass
        if "warc-block-digest" in head and _digest(block) != head["warc-block-digest"]:
            raise DamagedRecord(f"the block of {head['warc-record-id']} has another digest")
        yield head, block


def page(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest as hex, record_type, refers_to page_id, payload or None)."""
    number = lambda uri: int(x) if (x := uri.removeprefix("<urn:page:").removesuffix(">")) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    lines = iter([*http.split(b"\r\n")[1:], b""])
    size = int(_headers(lambda: next(lines))["content-length"])
    kind, told = head["warc-type"], head["warc-payload-digest"]
    if kind == "response" and (len(payload) != size or _digest(payload) != told):
        raise DamagedRecord(f"the payload of {head['warc-record-id']} has another length or digest")
    base32 = told.removeprefix("sha256:")
    hexed = base64.b32decode(base32 + "=" * (-len(base32) % 8)).hex()
    refers = number(head["warc-refers-to"]) if kind == "revisit" else None
    return number(head["warc-record-id"]), head.get("warc-target-uri"), size, hexed, kind, refers, payload if kind == "response" else None


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html, and first: the smallest page_id with the same payload, if that is another's and long enough."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.col("html"), F.octet_length(payload).alias("n"), F.sha2(payload.cast("binary"), 256).alias("h"))
    groups = rows.filter(F.col("n") >= MIN_REVISIT).groupBy("h", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    groups = cut(groups)
    total = groups.agg(F.sum("copies")).first()[0] or 0
    # copies of one page may be any share of all: the commonest are looked up where they stand, the rest meet by digest
    found = lookup(rows, groups, ["h", "n"], "copies", total, ["page_id"])
    return found.select("page_id", "url", "html", F.when(F.col("first").eqNullSafe(F.col("page_id")), None).otherwise(F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html); (path, n_records) of the archives."""

    def make():
        class Archives:
            out, n, size = None, 0, 0

            def close(self):
                if self.out is not None:
                    self.out.close()
                    yield [[self.path], [self.n]]
                    self.out = None

            def __call__(self, cols):
                for page_id, url, html, refers_to in zip(*cols, strict=True):
                    if self.out is None:
                        # a name of its own for each attempt: the manifest has those of the attempts that count
                        self.path, self.n, self.size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        fs, at = file_system(self.path)
                        self.out = fs.open_output_stream(at)
                    raw = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                    self.out.write(raw)
                    self.n, self.size = self.n + 1, self.size + len(raw)
                    if self.size > ARCHIVE_BYTES:
                        yield from self.close()

            def finish(self):
                yield from self.close()

        return Archives()

    return cut(map_rows(with_first(pages), ["page_id", "url", "html", "refers_to"], "path string, n_records long", make))


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives at ``path``; ``payload`` (of responses) only if asked for."""

    def make():
        def f(cols):
            for path in cols[0]:
                fs, at = file_system(path)
                with fs.open_input_stream(at) as stream:
                    rows = []
                    for head, block in read_records(stream):
                        own = page(head, block)
                        rows.append(own if payloads else own[:-1])
                        if len(rows) == 1000:
                            yield list(zip(*rows, strict=True))
                            rows = []
                    if rows:
                        yield list(zip(*rows, strict=True))

        return f

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    n = max(1, archives.count())
    return map_rows(archives.repartition(n), ["path"], schema, make)


def round_trip(pages: DataFrame) -> DataFrame:
    return read(write(pages.select("page_id", "url", "html"), scratch(pages.sparkSession, "warc")))
