"""Bulk export and import of pages as JSON lines, and as Markdown with front matter in archives; event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinds, text

#: What an export has and an import reads; fields that are missing are null.
PAGE = "title string, content string, domain string, project string, agent string, created_at string"
MOST = 10_000


def export_json(pages: DataFrame, path: str, most: int | None = MOST) -> None:
    """The newest pages (page_id, title, content, domain, project, created_at), at most ``most``, or all for None."""
    newest = pages.orderBy(F.desc("created_at"), F.desc("page_id")).limit(most) if most else pages
    out = newest.select("title", "content", "domain", "project", F.lit(None).cast("string").alias("agent"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def import_reason(longest: int = 200_000) -> Column:
    """Why a row is skipped, or null."""
    return (
        F.when(F.col("_corrupt").isNotNull(), "invalid")
        .when(F.trim(F.coalesce("content", F.lit(""))) == "", "empty")
        .when(F.char_length("content") > longest, "too long")
        .when(F.col("created_at").isNotNull() & F.col("created_at").try_cast("timestamp").isNull(), "bad date")
    )


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, skipped rows by reason) of JSON lines."""
    raw = spark.read.schema(f"{PAGE}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.withColumn("reason", import_reason())
    good = rows.filter("reason IS NULL").select(
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("untitled")).alias("title"), "content", kinds.input_domain(F.col("domain")).alias("domain"),
        F.nullif(text.sanitize_slug(F.coalesce("project", F.lit(""))), F.lit("")).alias("project"), F.col("created_at").try_cast("timestamp").alias("created_at"),
    )
    return good, rows.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def markdown(pages: DataFrame, escaped: bool = True) -> DataFrame:
    """(path, document) of each page: front matter, a heading, the text. Quotes and backslashes of a title are escaped between the
    front matter's quotes, or stand as they are."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
    title = F.replace(F.replace("title", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')) if escaped else F.col("title")
    quoted = F.concat(F.lit('"'), title, F.lit('"'))
    head = F.concat(
        F.lit("---\n"), field("id", F.col("page_id").cast("string")), field("title", quoted), field("domain", F.col("domain")),
        F.when(F.col("project").isNotNull(), field("project", F.col("project"))).otherwise(""), field("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("---\n\n"),
    )
    body = F.concat(F.lit("# "), text.trimmed(F.col("title")), F.lit("\n\n"), text.trimmed(F.col("content")), F.lit("\n"))
    return pages.select("page_id", text.wiki_path(F.col("domain"), F.col("title")).alias("path"), F.concat(head, body).alias("document"))


#: Documents of an archive, about.
ARCHIVED = 20_000


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Markdown documents of ``pages`` in gzipped tar archives below ``folder``, which all executors share, one for each task:
    (path, n) of the archives. Each attempt writes under a name of its own, and only those that count are returned."""
    import uuid

    from ..operators.state import cut

    spark = pages.sparkSession
    rows = markdown(pages)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm)
    at = fs.makeQualified(jvm).toString()

    def write(batches):
        import io
        import tarfile

        import pyarrow as pa
        from pyarrow import fs as stores

        path, n, out, tar = None, 0, None, None
        for batch in batches:
            for page_id, name, document in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tar is None:
                    path = f"{at}/{uuid.uuid4().hex}.tar.gz"
                    store, own = stores.FileSystem.from_uri(path)
                    out = store.open_output_stream(own, compression=None)
                    tar = tarfile.open(fileobj=out, mode="w|gz")
                raw = document.encode()
                info = tarfile.TarInfo(name)
                info.size, info.pax_headers = len(raw), {"page_id": str(page_id)}
                tar.addfile(info, io.BytesIO(raw))
                n += 1
        if tar is not None:
            tar.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    dealt = rows.repartition(max(1, -(-rows.count() // ARCHIVED)), "page_id")
    return cut(dealt.select("page_id", "path", "document").mapInArrow(write, "path string, n long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, path, document) of the archives at ``path``."""

    def read(batches):
        import tarfile

        import pyarrow as pa
        from pyarrow import fs as stores

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, own = stores.FileSystem.from_uri(path)
                with store.open_input_stream(own, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                    for info in tar:
                        yield pa.RecordBatch.from_pydict({"page_id": pa.array([int(info.pax_headers["page_id"])], pa.int64()), "path": [info.name], "document": [tar.extractfile(info).read().decode()]})

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(read, "page_id long, path string, document string")


EVENT = "question_id int, seq int, event string, data string"


def write_events(events: DataFrame, path: str) -> None:
    """Events (question_id, seq, event, data) as a client gets them, a line each: ``id``, ``event`` and ``data`` of one event, with
    an answer's events in one file, in order."""
    line = F.to_json(F.struct(F.concat_ws("-", "question_id", "seq").alias("id"), "event", "data"))
    events.repartition("question_id").sortWithinPartitions("question_id", "seq").select(line.alias("value")).write.mode("overwrite").text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("id string, event string, data string").json(path)
    of = lambda i: F.split("id", "-")[i].cast("int")
    return rows.select(of(0).alias("question_id"), of(1).alias("seq"), "event", F.coalesce("data", F.lit("")).alias("data"))
