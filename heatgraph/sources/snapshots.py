"""Index snapshots: Parquet tables in a folder of their own, and a pointer that is set when all are written."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "files": "path string, content_hash string, mtime double, chunk_count int",
    "chunks": "id long, file_path string, text string, byte_start int, byte_end int, line_start int, line_end int",
    "chunk_vectors": "chunk_id long, vector array<double>",
    "subchunks": "chunk_id long, ord int, vector array<double>",
    "edges": "src long, dst long, weight double",
    "communities": "chunk_id long, community_id int",
    "manifest": "key string, value string",
}
VERSION = "1"


class Snapshots:
    """The versions of an index under ``folder``, in any file system Spark writes to.

    A version is never changed. The pointer is a table of (version, number) rows, appended after the tables: a job that
    dies before leaves the previous version in place.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def current(self) -> str | None:
        if not self._exists(f"{self.folder}/pointer"):
            return None
        rows = self.spark.read.schema("version string, number long").json(f"{self.folder}/pointer").orderBy(F.desc("number"), F.desc("version")).take(1)
        return rows[0]["version"] if rows else None

    def table(self, name: str) -> DataFrame:
        """A table of the current version; empty if there is none."""
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{version}/{name}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in SCHEMAS}

    def manifest(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.table("manifest").collect()}

    def write(self, tables: Mapping[str, DataFrame], manifest: Mapping[str, object]) -> str:
        version = uuid.uuid4().hex
        rows = [(k, str(v)) for k, v in {**manifest, "schema_version": VERSION}.items()]
        every = {**tables, "manifest": self.spark.createDataFrame(rows, SCHEMAS["manifest"])}
        for name, ddl in SCHEMAS.items():
            empty = self.spark.createDataFrame([], ddl)
            df = every.get(name, empty)
            df.select(*(F.col(f.name).cast(f.dataType) for f in empty.schema)).write.parquet(f"{self.folder}/{version}/{name}")
        number = 0
        if self.current() is not None:
            number = self.spark.read.schema("version string, number long").json(f"{self.folder}/pointer").agg(F.max("number")).first()[0] + 1
        self.spark.createDataFrame([(version, number)], "version string, number long").coalesce(1).write.mode("append").json(f"{self.folder}/pointer")
        return version
