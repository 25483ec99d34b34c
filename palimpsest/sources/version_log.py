"""A versioned relation in storage: begun versions and end marks are appended, and readers put them together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.versions import BEGIN, END, IDENTITY, VERSION, marked, row_changes


class VersionLog:
    """Two folders of Parquet files, one of versions and one of end marks; a commit appends to both and rewrites neither.

    Every attempt at a commit writes files under a name of its own, and counts from when that name stands in the
    folder of commits, so readers don't see one that stopped in the middle.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def create(self, versions: DataFrame) -> None:
        """A new log of these versions."""
        name = uuid.uuid4().hex
        versions.select(*VERSION, *BEGIN, *END, *[c for c in versions.columns if c not in (*VERSION, *BEGIN, *END)]).write.parquet(f"{self.folder}/versions/part={name}")
        versions.select(*IDENTITY, *END).limit(0).write.parquet(f"{self.folder}/marks/part={name}")
        self._commit(name)

    def _commit(self, name: str) -> None:
        self.spark.range(1).select(F.lit(name).alias("part")).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _committed(self, kind: str) -> DataFrame:
        done = self.spark.read.parquet(f"{self.folder}/commits").distinct()
        return self.spark.read.parquet(f"{self.folder}/{kind}").join(F.broadcast(done), "part", "left_semi").drop("part")

    def read(self) -> DataFrame:
        """All versions with their end marks."""
        return marked(self._committed("versions"), self._committed("marks"))

    def append(self, writes: DataFrame, xid: int, csn: int | None, payload: list[str]) -> None:
        """One transaction's writes (_rid, op, _cid, payload); inserts, single or many, are writes with op INSERT."""
        begun, ended = row_changes(self.read(), writes, xid, csn, payload)
        name = uuid.uuid4().hex
        begun.write.parquet(f"{self.folder}/versions/part={name}")
        ended.select(*IDENTITY, *END).write.parquet(f"{self.folder}/marks/part={name}")
        self._commit(name)
