"""Databases: a folder with a Parquet table per entry, or DataFrames registered by name."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Tables by name, opened lazily; nothing is read but footers until a query runs."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path
        self._frames: dict[str, DataFrame] = {}
        self._versions: dict[str, str] = {}
        self._where: dict[str, str] = {}
        if path:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            for entry in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop):
                name = entry.getPath().getName()
                if not name.startswith(("_", ".")) and (entry.isDirectory() or name.endswith(".parquet")):
                    self._where[name.removesuffix(".parquet")] = f"{path.rstrip('/')}/{name}"

    def register(self, name: str, frame: DataFrame) -> None:
        self._frames[name], self._versions[name] = frame, uuid.uuid4().hex

    def version(self, name: str) -> str:
        """Tells one state of a table from another: place, time, files and bytes of its folder; looked up once until it is written anew."""
        if name not in self._versions:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self._where[name])
            system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
            total = system.getContentSummary(where)
            self._versions[name] = f"{self._where[name]} {system.getFileStatus(where).getModificationTime()} {total.getFileCount()} {total.getLength()}"
        return self._versions[name]

    def names(self) -> list[str]:
        return sorted({*self._frames, *self._where})

    def __contains__(self, name: str) -> bool:
        return name in self._frames or name in self._where

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(self._where[name])
        return self._frames[name]

    def __getitem__(self, name: str):
        """The schema, so that a catalog serves as a parser's schemas."""
        if name not in self:
            raise KeyError(name)
        return self.table(name).schema

    def views(self) -> None:
        """Register every table as a temporary view."""
        for name in self.names():
            self.table(name).createOrReplaceTempView(name)

    def write(self, name: str, frame: DataFrame) -> None:
        """Add a table to the folder."""
        where = os.path.join(self.path, f"{name}.parquet") if "://" not in self.path else f"{self.path.rstrip('/')}/{name}.parquet"
        frame.write.mode("overwrite").parquet(where)
        self._where[name] = where
        self._frames.pop(name, None)
        self._versions.pop(name, None)
