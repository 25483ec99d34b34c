"""Transactions over a versioned relation: staged writes, command ids, savepoints, isolation, pinned snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.order import written
from palimpsest.operators.versions import Snapshot, apply_writes, vacuum, write_verdicts


class Relation:
    """A versioned relation with a commit counter; a commit replaces its frame of versions."""

    def __init__(self, versions: DataFrame, payload: list[str], csn: int = 1):
        self.versions, self.payload, self.csn, self.xid = versions, payload, csn, 0
        self.pinned: dict[str, int] = {}
        self.status: dict[int, tuple[str, int | None]] = {}

    def begin(self, isolation: str = "read committed") -> Transaction:
        self.xid += 1
        self.status[self.xid] = ("in progress", None)
        return Transaction(self, self.xid, isolation)

    def pin(self, cursor: str, csn: int | None = None) -> None:
        """A cursor's snapshot holds back what vacuum may drop."""
        self.pinned[cursor] = self.csn if csn is None else csn

    def vacuum(self) -> DataFrame:
        self.versions = vacuum(self.versions, min([self.csn, *self.pinned.values()]))
        return self.versions


class Conflict(RuntimeError):
    pass


class Transaction:
    """Writes are staged as small frames and applied at commit; own rows are seen from the next command on."""

    def __init__(self, relation: Relation, xid: int, isolation: str):
        if isolation not in ("read committed", "transaction snapshot"):
            raise ValueError(f"isolation {isolation} isn't supported")
        self.relation, self.xid, self.isolation = relation, xid, isolation
        self.first_csn = relation.csn
        self.staged: list[DataFrame] = []
        self.savepoints: list[tuple[str, int]] = []
        self.open = True

    def _csn(self) -> int:
        return self.relation.csn if self.isolation == "read committed" else self.first_csn

    def _write(self, rows: DataFrame, op: str) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")
        payload = [F.col(c) if c in rows.columns else F.lit(None).cast(self.relation.versions.schema[c].dataType).alias(c) for c in self.relation.payload]
        self.staged.append(rows.select("_rid", F.lit(op).alias("op"), F.lit(len(self.staged)).cast("long").alias("_cid"), *payload))

    def insert(self, rows: DataFrame) -> None:
        self._write(rows, "INSERT")

    def update(self, rows: DataFrame) -> None:
        self._write(rows, "UPDATE")

    def delete(self, rids: DataFrame) -> None:
        self._write(rids, "DELETE")

    def rollback_statement(self) -> None:
        """Takes back the last write, as after a conflict of an insert; the transaction goes on."""
        self.staged.pop()
        self.savepoints = [(name, min(at, len(self.staged))) for name, at in self.savepoints]

    def _applied(self, csn: int | None) -> DataFrame:
        return reduce(lambda v, w: apply_writes(v, w, self.xid, csn, self.relation.payload), self.staged, self.relation.versions)

    def read(self) -> DataFrame:
        """The rows that the next command sees."""
        return self._applied(None).where(Snapshot(self._csn(), self.xid, len(self.staged)).visible())

    def savepoint(self, name: str) -> None:
        self.savepoints.append((name, len(self.staged)))

    def _newest(self, name: str) -> int:
        for i in range(len(self.savepoints) - 1, -1, -1):
            if self.savepoints[i][0] == name:
                return i
        raise KeyError(name)

    def release(self, name: str) -> None:
        """Drops the newest savepoint of that name and all after it; writes stay."""
        del self.savepoints[self._newest(name) :]

    def rollback_to(self, name: str) -> None:
        """Takes back the writes since the newest savepoint of that name, which stays."""
        at = self._newest(name)
        del self.staged[self.savepoints[at][1] :]
        del self.savepoints[at + 1 :]

    def commit(self) -> int:
        """Stamps the writes with the next csn, or raises Conflict if another commit changed their rows since."""
        since = self.relation.versions.where(F.col("_end_csn").isNull() | (F.col("_end_csn") >= self.first_csn))
        for w in self.staged:
            bad = write_verdicts(w.where("op <> 'INSERT'").select("_rid"), since, Snapshot(self.first_csn, self.xid, 0)).where("verdict in ('updated', 'deleted')")
            if not bad.isEmpty():
                self.abort()
                raise Conflict("a row has changed since the transaction began")
        csn = self.relation.csn
        self.relation.versions = self._applied(csn)
        self.relation.csn, self.open = csn + 1, False
        self.relation.status[self.xid] = ("committed", csn)
        return csn

    def abort(self) -> None:
        self.staged, self.open = [], False
        self.relation.status[self.xid] = ("aborted", None)


#: Table lock modes from weakest to strongest, and for each those that it conflicts with.
LOCK_CONFLICTS = {
    "access share": ("access exclusive",),
    "row share": ("exclusive", "access exclusive"),
    "row exclusive": ("share", "share row exclusive", "exclusive", "access exclusive"),
    "share update exclusive": ("share update exclusive", "share", "share row exclusive", "exclusive", "access exclusive"),
    "share": ("row exclusive", "share update exclusive", "share row exclusive", "exclusive", "access exclusive"),
    "share row exclusive": ("row exclusive", "share update exclusive", "share", "share row exclusive", "exclusive", "access exclusive"),
    "exclusive": ("row share", "row exclusive", "share update exclusive", "share", "share row exclusive", "exclusive", "access exclusive"),
    "access exclusive": ("access share", "row share", "row exclusive", "share update exclusive", "share", "share row exclusive", "exclusive", "access exclusive"),
}


def waits(requests: DataFrame) -> DataFrame:
    """(waiter, holder): requests (xid, object, mode, granted) that wait for a granted lock of a conflicting mode."""
    pairs = [(a, b) for a, others in LOCK_CONFLICTS.items() for b in others]
    conflicts = requests.sparkSession.createDataFrame(pairs, "mode string, held string")
    held = requests.where("granted").select("object", F.col("mode").alias("held"), F.col("xid").alias("holder"))
    asked = requests.where("not granted").join(F.broadcast(conflicts), "mode")
    return asked.join(held, ["object", "held"]).where("xid <> holder").select(F.col("xid").alias("waiter"), "holder").distinct()


def deadlocked(wait_for: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Transactions that lie on or wait for a cycle: what stays when those that wait for nothing are taken away round by round."""
    left = wait_for
    for _ in range(max_rounds):
        kept = written(left.join(left.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi").select("waiter", "holder"))
        if kept.count() == left.count():
            return kept.select("waiter").distinct()
        left = kept
    raise RuntimeError("the wait-for graph did not settle")
