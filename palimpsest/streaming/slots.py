"""Replication slots over Structured Streaming: transactions are emitted whole, in commit order, at least once.

Change records (lsn, xid, kind, csn, op, payload) arrive as files. Each micro-batch joins the changes that
wait to the new ones, finds the lowest commit number still being committed, and emits the committed
transactions below it. A batch starts from the state that the batch before it left, and leaves its own by one
rename, so one that runs again after a failure does the same again. The last two states and their tables of
waiting changes are kept.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Slot:
    """A slot's folder: for each batch the confirmed commit number, and the changes that wait after it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, name: str, value: dict) -> None:
        """Writes a small file whole: under another name first, then renamed."""
        passing = self._path(f"_{name.replace('/', '-')}")
        out = self._fs.create(passing, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self._fs.mkdirs(self._path(name).getParent())
        self._fs.delete(self._path(name), False)
        if not self._fs.rename(passing, self._path(name)):
            raise OSError(f"{name} of the slot {self.folder} can't be written")

    def _get(self, name: str) -> dict | None:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0]) if self._fs.exists(self._path(name)) else None

    def _batches(self) -> list[int]:
        there = self._fs.listStatus(self._path("state")) if self._fs.exists(self._path("state")) else []
        return sorted(int(f.getPath().getName()) for f in there)

    def state(self, before: int | None = None) -> dict:
        """The state that the last batch, or the last one before that number, has left; an explicit advance counts beside it."""
        batches = [b for b in self._batches() if before is None or b < before]
        found = self._get(f"state/{batches[-1]:09d}") if batches else {"confirmed": -1, "batch": -1}
        return {**found, "confirmed": max(found["confirmed"], (self._get("advanced") or {"confirmed": -1})["confirmed"])}

    @property
    def confirmed_csn(self) -> int:
        return self.state()["confirmed"]

    def advance(self, csn: int) -> None:
        """Confirms all commits up to csn; never goes back."""
        self._put("advanced", {"confirmed": max(csn, self.confirmed_csn)})

    def leave(self, batch: int, confirmed: int) -> None:
        """A batch's state; those before the last two go, with their waiting changes."""
        self._put(f"state/{batch:09d}", {"confirmed": confirmed, "batch": batch})
        for old in self._batches()[:-2]:
            self._fs.delete(self._path(f"state/{old:09d}"), False)
            self._fs.delete(self._path(f"waiting-{old}"), True)

    def waiting(self, batch: int) -> DataFrame | None:
        """The changes that wait after that batch."""
        name = f"waiting-{batch}"
        return self.spark.read.parquet(f"{self.folder}/{name}") if batch >= 0 and self._fs.exists(self._path(name)) else None

    def start_point(self) -> dict:
        """Where reading has to begin again: confirmed csn, and the least lsn that still waits (None if none does)."""
        state = self.state()
        waiting = self.waiting(state["batch"])
        return {"confirmed": state["confirmed"], "restart_lsn": None if waiting is None else waiting.agg(F.min("lsn")).first()[0]}

    def acquire(self) -> None:
        """Takes the slot for one reader; an error if another has it."""
        self._fs.mkdirs(self._path(""))
        if not self._fs.createNewFile(self._path("acquired")):
            raise RuntimeError(f"the slot {self.folder} is in use")

    def release(self) -> None:
        self._fs.delete(self._path("acquired"), False)

    def drop(self) -> None:
        self._fs.delete(self._path(""), True)


def emit_ready(records: DataFrame, confirmed_csn: int) -> tuple[DataFrame, DataFrame]:
    """(ready, waiting) of records with kind ROW, COMMITTING, COMMIT or ABORT.

    A committed transaction is ready if no transaction with a lower commit number is still committing.
    Aborted transactions and those that the slot has confirmed are dropped.
    """
    ends = records.where("kind <> 'ROW'").groupBy("xid").agg(
        F.max(F.when(F.col("kind") == "COMMIT", F.col("csn"))).alias("commit_csn"), F.max(F.when(F.col("kind") == "COMMITTING", F.col("csn"))).alias("committing_csn"),
        F.bool_or(F.col("kind") == "ABORT").alias("aborted"))
    open_csn = ends.where("commit_csn is null and not aborted").agg(F.min("committing_csn").alias("open"))
    known = records.join(ends.crossJoin(F.broadcast(open_csn)), "xid", "left").where("not coalesce(aborted, false)")
    known = known.where(F.col("commit_csn").isNull() | (F.col("commit_csn") > confirmed_csn))
    ready = F.col("commit_csn").isNotNull() & (F.col("open").isNull() | (F.col("commit_csn") < F.col("open")))
    rows = known.where(ready & (F.col("kind") == "ROW")).select(*[c for c in records.columns if c not in ("kind", "csn")], F.col("commit_csn").alias("csn"))
    return rows, known.where(~ready).select(*records.columns)


def stream(spark: SparkSession, source: DataFrame, slot: Slot, out: str) -> StreamingQuery:
    """Runs the slot over a streaming frame of records until its input is used up; ready rows go to the folder out.

    A batch that runs again after a failure starts from the state before it, whatever it had left itself, and
    overwrites its own output; the state follows the output, so no transaction is confirmed that isn't out.
    """

    def each(batch: DataFrame, number: int) -> None:
        state = slot.state(before=number)
        waiting = slot.waiting(state["batch"])
        records = batch if waiting is None else waiting.unionByName(batch)
        ready, rest = emit_ready(records, state["confirmed"])
        ready.write.mode("overwrite").parquet(f"{out}/batch={number}")
        rest.write.mode("overwrite").parquet(f"{slot.folder}/waiting-{number}")
        last = spark.read.parquet(f"{out}/batch={number}").agg(F.max("csn")).first()[0]
        slot.leave(number, state["confirmed"] if last is None else last)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", f"{slot.folder}/checkpoint").trigger(availableNow=True).start()
