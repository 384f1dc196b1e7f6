"""Tables in partitions that are replaced or deleted one by one, and read as whole versions.

A table is kept by one column, an organization or a bucket of keys. Its rows lie in a folder for each value; a manifest names the
folders that make up a version. A write puts new folders beside the old ones and then a new manifest, so readers see one version or
the next, and a write that fails leaves nothing that is read. A reader of some values opens their folders alone. ``vacuum`` deletes
folders that recent manifests don't name: what was purged is gone from the disk then.

One writer at a time: of two that write the same version the second fails. Values are as many as fit a manifest, which the driver
reads: organizations and buckets, not keys of rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, folder string, n long"


def _part(value: Column) -> Column:
    """A value as the name of a folder."""
    return F.coalesce(F.lower(F.hex(F.encode(value.cast("string"), "utf-8"))), F.lit("null"))


def _name(value) -> str:
    return "null" if value is None else str(value).encode().hex()


class Versioned:
    def __init__(self, spark: SparkSession, path: str, by: str):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._at = lambda p: hadoop.Path(f"{self.path}/{p}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, df: DataFrame, path: str, by: str) -> Versioned:
        table = cls(df.sparkSession, path, by)
        df.limit(0).write.parquet(f"{table.path}/schema")
        table._commit({}, table._written(df))
        return table

    def versions(self) -> list[int]:
        """Numbers of the versions that were written whole."""
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n[1:]) for n in names if self._fs.exists(self._at(f"manifests/{n}/_SUCCESS")))

    def manifest(self, version: int | None = None) -> dict[str, tuple[str, int]]:
        """{part: (folder, rows)} of a version, of the last if none is named."""
        all_ = self.versions()
        if not all_:
            return {}
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v{all_[-1] if version is None else version:06d}").collect()
        return {r.part: (r.folder, r.n) for r in rows}

    def read(self, values: Iterable | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, or those of some values, of which alone the files are opened."""
        have = self.manifest(version)
        wanted = have if values is None else [p for p in map(_name, values) if p in have]
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        paths = [f"{self.path}/data/{have[p][0]}/_part={p}" for p in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def overwrite(self, df: DataFrame, values: Iterable | None = None) -> None:
        """The rows of ``df`` in place of all rows of their values, and of ``values``, which may be left without rows."""
        new = self._written(df)
        gone = {*new, *map(_name, values or ())}
        self._commit({p: x for p, x in self.manifest().items() if p not in gone}, new)

    def purge(self, values: Iterable) -> None:
        """A version without the rows of ``values``."""
        gone = set(map(_name, values))
        self._commit({p: x for p, x in self.manifest().items() if p not in gone}, {})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes versions before the last ``keep``, and folders that none of these names: their names."""
        versions = self.versions()
        used = {f"{folder}/_part={p}" for v in versions[-keep:] for p, (folder, _) in self.manifest(v).items()}
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"manifests/v{v:06d}"), True)
        gone = []
        for folder in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            parts = [x.getPath() for x in self._fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("_part=")]
            for part in parts:
                name = f"{folder.getPath().getName()}/{part.getName()}"
                if name not in used:
                    self._fs.delete(part, True)
                    gone.append(name)
            if len(parts) and all(f"{folder.getPath().getName()}/{x.getName()}" in gone for x in parts):
                self._fs.delete(folder.getPath(), True)
        return gone

    def _written(self, df: DataFrame) -> dict[str, tuple[str, int]]:
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        rows = df.withColumn("_part", _part(F.col(self.by)))
        # rows of a value come together; a value of any share of them is split again by its size
        rows.hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(at)
        if not any(x.getPath().getName().startswith("_part=") for x in self._fs.listStatus(self._at(f"data/{folder}"))):
            return {}
        counts = self.spark.read.schema("_part string").parquet(at).groupBy("_part").count().collect()
        return {r._part: (folder, r["count"]) for r in counts}

    def _commit(self, kept: dict, new: dict) -> None:
        rows = [(p, folder, n) for p, (folder, n) in {**kept, **new}.items()]
        number = (self.versions() or [0])[-1] + 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/v{number:06d}")
