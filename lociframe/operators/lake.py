"""Parquet tables with snapshots: append, schema evolution, merge, time travel.

A table is a folder with data/ (Parquet folders, one per commit) and _snapshots/N.json, which lists the data folders of
snapshot N, its schema and commit message. A snapshot is written under a new name and never changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def snapshots(self) -> list[int]:
        folder = self.fs_path(f"{self.path}/_snapshots")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def snapshot(self, version: int | None = None) -> dict:
        version = self.snapshots()[-1] if version is None else version
        stream = self.fs.open(self.fs_path(f"{self.path}/_snapshots/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, files: list[str], schema: StructType, message: str, author: str) -> int:
        version = (self.snapshots() or [0])[-1] + 1
        body = json.dumps({"version": version, "files": files, "schema": schema.jsonValue(), "message": message, "author": author})
        stream = self.fs.create(self.fs_path(f"{self.path}/_snapshots/{version}.json"), False)  # fails if another writer was first
        stream.write(bytearray(body.encode()))
        stream.close()
        return version

    def _write(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def files(self, version: int | None = None) -> list[str]:
        return self.snapshot(version)["files"]

    def read(self, version: int | None = None) -> DataFrame:
        """The table, or its state at a version; columns added later are null in older files."""
        s = self.snapshot(version)
        return self.spark.read.schema(StructType.fromJson(s["schema"])).parquet(*[f if "://" in f or f.startswith("/") else f"{self.path}/{f}" for f in s["files"]])

    def append(self, df: DataFrame, evolve: bool = False, message: str = "append", author: str = "") -> int:
        """Rows by column name. New columns need evolve; columns that df lacks become null."""
        if not self.snapshots():
            return self._commit([self._write(df)], df.schema, message, author)
        s = self.snapshot()
        schema = StructType.fromJson(s["schema"])
        new = [f for f in df.schema.fields if f.name not in schema.fieldNames()]
        if new and not evolve:
            raise ValueError(f"new columns: {[f.name for f in new]}")
        return self._commit([*s["files"], self._write(df)], StructType([*schema.fields, *new]), message, author)

    def register(self, path: str, message: str = "register") -> int:
        """Adds an existing Parquet folder without copying it."""
        s = self.snapshot()
        return self._commit([*s["files"], path], StructType.fromJson(s["schema"]), message, "")

    def merge(self, source: DataFrame, keys: list[str], matched: str = "update", not_matched: str = "insert", columns: list[str] | None = None, message: str = "merge") -> int:
        """Upsert. matched: update (columns, or all), delete or keep; not_matched: insert or skip."""
        target = self.read()
        return self._commit([self._write(merged(target, source, keys, matched, not_matched, columns))], target.schema, message, "")


def merged(target: DataFrame, source: DataFrame, keys: list[str], matched: str = "update", not_matched: str = "insert", columns: list[str] | None = None) -> DataFrame:
    """target after a MERGE with source, whose keys are unique: one full outer join."""
    columns = [c for c in (columns or target.columns) if c not in keys]
    t = target.select(*keys, *(F.col(c).alias(f"_t_{c}") for c in target.columns if c not in keys), F.lit(True).alias("_in_t"))
    s = source.select(*keys, *(F.col(c).alias(f"_s_{c}") for c in source.columns if c not in keys), F.lit(True).alias("_in_s"))
    both = t.join(s, keys, "full" if not_matched == "insert" else "left")
    hit = F.col("_in_t").isNotNull() & F.col("_in_s").isNotNull()

    def value(c: str) -> Column:
        old, new = F.col(f"_t_{c}"), F.col(f"_s_{c}") if c in source.columns else F.lit(None)
        return F.when(hit, new if matched == "update" and c in columns and c in source.columns else old).when(F.col("_in_t").isNotNull(), old).otherwise(new)

    if matched == "delete":
        both = both.where(~hit)
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in target.columns])


def evolved(*parts: DataFrame) -> DataFrame:
    """Union by name; columns missing in a part are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
