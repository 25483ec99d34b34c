"""Queries over versioned rows: visibility, isolation, time travel, DML, clean-up, LOBs, sequences, locks, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import lobs, versions
from palimpsest.operators.order import fresh_folder, running
from palimpsest.operators.sequences import Sequence
from palimpsest.operators.transactions import Relation, deadlocked, waits
from palimpsest.operators.versions import Snapshot
from palimpsest.plans.register import Registry
from palimpsest.sources.tables import VERSIONS_SQL, order_versions, table
from palimpsest.sources.version_log import VersionLog

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

SHOWN = ["_rid", "_ver", "o_totalprice"]
PAYLOAD = ["o_custkey", "o_totalprice"]


def _versions(spark, d):
    return order_versions(table(spark, d, "orders"))


def _sql(where: str, columns: str = "_rid, _ver, o_totalprice") -> str:
    return f"{VERSIONS_SQL} SELECT {columns} FROM v WHERE {where}"


def _seen(csn: int | None = None, own: str = "false", end_own: str = "false") -> str:
    """SQL of visibility at csn, or now."""
    begin = "_begin_csn IS NOT NULL" if csn is None else f"coalesce(_begin_csn < {csn}, false)"
    end = "_end_csn IS NOT NULL" if csn is None else f"coalesce(_end_csn < {csn}, false)"
    return f"(({begin} OR {own}) AND NOT ({end} OR coalesce({end_own}, false)))"


@query("mvcc_visible", _sql(_seen(60)))
def mvcc_visible(spark, d):
    return _versions(spark, d).where(Snapshot(60).visible()).select(*SHOWN)


@query("mvcc_own_cid", _sql(_seen(30, "(_begin_xid = 40 AND _begin_cid < 2)", "(_end_xid = 40 AND _end_cid < 2)")))
def mvcc_own_cid(spark, d):
    return _versions(spark, d).where(Snapshot(30, xid=40, cid=2).visible()).select(*SHOWN)


@query("mvcc_now", _sql(_seen()))
def mvcc_now(spark, d):
    return _versions(spark, d).where(Snapshot().visible()).select(*SHOWN)


@query("mvcc_dirty", _sql("_begin_xid IS NOT NULL AND _end_xid IS NULL"))
def mvcc_dirty(spark, d):
    return _versions(spark, d).where(Snapshot(dirty=True).visible()).select(*SHOWN)


@query("show_any_version", _sql("true", "_rid, _ver, _begin_xid, _end_xid"))
def show_any_version(spark, d):
    return _versions(spark, d).select("_rid", "_ver", "_begin_xid", "_end_xid")


def _isolated(spark, d, isolation: str):
    """What a transaction begun at csn 50 reads after another has committed an update of rows below 300."""
    relation = Relation(_versions(spark, d).where("_begin_csn < 50 and (_end_csn is null or _end_csn < 50)"), PAYLOAD, csn=50)
    reader, writer = relation.begin(isolation), relation.begin()
    writer.update(relation.versions.where("_rid < 300").where(Snapshot(50).visible()).select("_rid", "o_custkey", (F.col("o_totalprice") + 1000).alias("o_totalprice")))
    writer.commit()
    return reader.read().select("_rid", "o_totalprice")


_BEFORE_50 = "_begin_csn < 50 AND (_end_csn IS NULL OR _end_csn < 50)"


@query("iso_read_committed", f"{VERSIONS_SQL} SELECT _rid, o_totalprice + CASE WHEN _rid < 300 THEN 1000 ELSE 0 END AS o_totalprice FROM v WHERE _begin_csn < 50 AND _end_csn IS NULL")
def iso_read_committed(spark, d):
    return _isolated(spark, d, "read committed")


@query("iso_txn_snapshot", f"{VERSIONS_SQL} SELECT _rid, o_totalprice FROM v WHERE _begin_csn < 50 AND _end_csn IS NULL")
def iso_txn_snapshot(spark, d):
    return _isolated(spark, d, "transaction snapshot")


@query("txn_savepoint", f"{VERSIONS_SQL} SELECT _rid, o_totalprice FROM v WHERE {_seen()} AND _rid % 3 <> 0 UNION ALL SELECT -o_orderkey - 1, 1.0::DOUBLE FROM orders WHERE o_orderkey < 5")
def txn_savepoint(spark, d):
    relation = Relation(_versions(spark, d).where("_begin_csn is not null"), PAYLOAD, csn=200)
    t = relation.begin()
    t.insert(table(spark, d, "orders").where("o_orderkey < 5").select((-F.col("o_orderkey") - 1).alias("_rid"), "o_custkey", F.lit(1.0).alias("o_totalprice")))
    t.savepoint("a")
    t.delete(relation.versions.select("_rid").distinct())
    t.rollback_to("a")
    t.delete(relation.versions.where("_rid % 3 = 0").select("_rid").distinct())
    t.commit()
    return versions.as_of(relation.versions).select("_rid", "o_totalprice")


@query("xid_status", """SELECT o_orderkey % 97 + 1 AS xid, CASE WHEN bool_or(o_orderstatus <> 'P') THEN 'committed' ELSE 'in progress' END AS status,
max(CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 97 + 1 END) AS csn FROM orders GROUP BY 1""")
def xid_status(spark, d):
    found = _versions(spark, d).where("_ver = 1").groupBy(F.col("_begin_xid").alias("xid")).agg(F.max("_begin_csn").alias("csn"))
    return found.select("xid", F.when(F.col("csn").isNotNull(), "committed").otherwise("in progress").alias("status"), "csn")


@query("as_of", _sql(_seen(60), "_rid, o_custkey, o_totalprice"))
def as_of(spark, d):
    return versions.as_of(_versions(spark, d), 60).select("_rid", "o_custkey", "o_totalprice")


@query("fb_delta", _sql(f"{_seen()} AND NOT {_seen(60)}"))
def fb_delta(spark, d):
    return versions.delta(_versions(spark, d), 60).select(*SHOWN)


@query("fb_lost", _sql(f"{_seen(60)} AND NOT {_seen()}"))
def fb_lost(spark, d):
    return versions.lost(_versions(spark, d), 60).select(*SHOWN)


@query("fb_table", _sql(_seen(60)))
def fb_table(spark, d):
    return versions.flashback(_versions(spark, d), 60).select(*SHOWN)


def _writes(spark, d):
    """Transaction 200's writes: updates, deletes and inserts by the last digit of the order key."""
    key = F.col("o_orderkey")
    op = F.when(key % 10 == 1, "UPDATE").when(key % 10 == 2, "DELETE")
    changed = table(spark, d, "orders").where(op.isNotNull() & (F.col("o_orderstatus") != "P")).select(key.alias("_rid"), op.alias("op"), F.lit(0).cast("long").alias("_cid"), "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    added = table(spark, d, "orders").where("o_orderkey < 50").select((key + 1_000_000).alias("_rid"), F.lit("INSERT").alias("op"), F.lit(1).cast("long").alias("_cid"), "o_custkey", "o_totalprice")
    return changed.unionByName(added)


@query("dml_final_state", f"""{VERSIONS_SQL} SELECT _rid, CASE WHEN _rid % 10 = 1 THEN 2 ELSE _ver END AS _ver, CASE WHEN _rid % 10 = 1 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
FROM v WHERE {_seen()} AND _rid % 10 <> 2 UNION ALL SELECT o_orderkey + 1000000, 1, o_totalprice FROM orders WHERE o_orderkey < 50""")
def dml_final_state(spark, d):
    after = versions.apply_writes(_versions(spark, d), _writes(spark, d), 200, 200, PAYLOAD)
    return versions.as_of(after).select(*SHOWN)


@query("dml_uncommitted", f"{VERSIONS_SQL} SELECT count(*) AS n FROM v WHERE {_seen()}")
def dml_uncommitted(spark, d):
    after = versions.apply_writes(_versions(spark, d), _writes(spark, d), 200, None, PAYLOAD)
    return versions.as_of(after).agg(F.count("*").alias("n"))


@query("dml_conflicts", f"""{VERSIONS_SQL}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _rid ORDER BY _ver DESC) AS k FROM v) WHERE k = 1)
SELECT w.o_orderkey + 5000 AS _rid, CASE WHEN n._rid IS NULL THEN 'missing' WHEN _end_xid = 70 THEN 'self_modified' WHEN _end_xid IS NOT NULL THEN 'deleted' WHEN _begin_xid = 70 THEN 'self_created'
WHEN _begin_csn IS NULL THEN 'invisible' WHEN _begin_csn >= 60 AND _ver > 1 THEN 'updated' WHEN _begin_csn >= 60 THEN 'invisible' ELSE 'ok' END AS verdict FROM orders w LEFT JOIN n ON n._rid = w.o_orderkey + 5000""")
def dml_conflicts(spark, d):
    writes = table(spark, d, "orders").select((F.col("o_orderkey") + 5000).alias("_rid"))
    return versions.write_verdicts(writes, _versions(spark, d), Snapshot(60, xid=70, cid=0))


@query("dml_in_progress", f"""{VERSIONS_SQL} SELECT o_orderkey AS _rid, CASE WHEN _begin_csn IS NULL THEN 'invisible' WHEN o_orderkey % 10 = 1 AND o_orderkey % 3 > 0 THEN 'self_modified' WHEN o_orderkey % 10 = 2 THEN 'being_modified' WHEN _end_xid IS NOT NULL THEN 'deleted'
ELSE 'ok' END AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY _rid ORDER BY _ver DESC) AS k FROM v) v JOIN orders ON o_orderkey = _rid WHERE k = 1 AND NOT (_rid % 10 = 1 AND _rid % 3 = 0)""")
def dml_in_progress(spark, d):
    """What transaction 201 finds while it and 200 have writes that aren't committed."""
    writes = _writes(spark, d).where("op <> 'INSERT'")
    after = versions.apply_writes(_versions(spark, d), writes.where("op = 'DELETE'"), 200, None, PAYLOAD)
    after = versions.apply_writes(after, writes.where("op = 'UPDATE' and _rid % 3 > 0").withColumn("op", F.lit("DELETE")), 201, None, PAYLOAD)
    asked = table(spark, d, "orders").where("not (o_orderkey % 10 = 1 and o_orderkey % 3 = 0)").select(F.col("o_orderkey").alias("_rid"))
    return versions.write_verdicts(asked, after, Snapshot(xid=201, cid=9))


@query("dml_old_rows", f"{VERSIONS_SQL} SELECT _rid, _ver, CASE WHEN _rid % 10 = 1 THEN 'UPDATE' ELSE 'DELETE' END AS op, o_custkey, o_totalprice FROM v WHERE {_seen()} AND _rid % 10 IN (1, 2)")
def dml_old_rows(spark, d):
    """The rows that an update and a delete have replaced, as they were."""
    return versions.row_changes(_versions(spark, d), _writes(spark, d), 200, 200, PAYLOAD)[1].select("_rid", "_ver", F.col("_op").alias("op"), *PAYLOAD)


@query("dml_identity_tuple", f"{VERSIONS_SQL} SELECT _rid, CASE WHEN _rid % 10 = 1 THEN 'UPDATE' ELSE 'DELETE' END AS op, o_custkey FROM v WHERE {_seen()} AND _rid % 10 IN (1, 2)")
def dml_identity_tuple(spark, d):
    ended = versions.row_changes(_versions(spark, d), _writes(spark, d), 200, 200, PAYLOAD)[1]
    return versions.identity(ended, ["o_custkey"]).select("_rid", "op", "identity.o_custkey")


@query("dml_lock_rows", f"""{VERSIONS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY _rid ORDER BY _ver DESC) AS k FROM v), s AS (SELECT _rid, _ver, o_totalprice FROM v WHERE {_seen(40)})
SELECT s._rid, CASE WHEN found = 'newest' THEN nv ELSE s._ver END AS _ver, found, CASE WHEN found = 'newest' THEN np ELSE s.o_totalprice END AS o_totalprice
FROM s JOIN (SELECT _rid, _ver AS nv, o_totalprice AS np, _end_xid AS e FROM n WHERE k = 1) USING (_rid), LATERAL (SELECT CASE WHEN e IS NOT NULL THEN 'gone' WHEN nv = s._ver THEN 'unchanged' ELSE 'newest' END AS found)""")
def dml_lock_rows(spark, d):
    return versions.lock_rows(_versions(spark, d), Snapshot(40), ["o_totalprice"])


@query("dml_append", f"""{VERSIONS_SQL} SELECT _rid, CASE WHEN _rid % 10 = 1 THEN 2 ELSE _ver END AS _ver, CASE WHEN _rid % 10 = 1 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
FROM v WHERE {_seen()} AND _rid % 10 <> 2 UNION ALL SELECT o_orderkey + 1000000, 1, o_totalprice FROM orders WHERE o_orderkey < 50""")
def dml_append(spark, d):
    """The same writes through storage: begun versions and end marks are appended to a log and read back."""
    log = VersionLog(spark, fresh_folder(spark))
    log.create(_versions(spark, d))
    log.append(_writes(spark, d), 200, 200, PAYLOAD)
    return versions.as_of(log.read()).select(*SHOWN)


@query("dml_for_update", f"{VERSIONS_SQL} SELECT _rid, max(_ver) AS _ver FROM v WHERE {_seen()} AND o_custkey < 50 GROUP BY _rid")
def dml_for_update(spark, d):
    return versions.as_of(_versions(spark, d)).where("o_custkey < 50").select("_rid", "_ver")


@query("dml_replica_identity", _sql("_end_csn IS NOT NULL", "_rid, _end_xid"))
def dml_replica_identity(spark, d):
    return _versions(spark, d).where("_end_csn is not null").select("_rid", "_end_xid")


@query("vacuum", _sql("_end_csn IS NULL OR _end_csn >= 55"))
def vacuum(spark, d):
    relation = Relation(_versions(spark, d), PAYLOAD, csn=120)
    relation.pin("cursor", 55)
    return relation.vacuum().select(*SHOWN)


@query("scan_live_dead", f"{VERSIONS_SQL} SELECT _rid // 1000 AS block, count(*) FILTER ({_seen()}) AS live, count(*) FILTER (NOT {_seen()}) AS dead FROM v GROUP BY 1")
def scan_live_dead(spark, d):
    return versions.block_statistics(_versions(spark, d), 1000)


@query("diag_free_space", f"{VERSIONS_SQL} SELECT _rid // 1000 AS block, greatest(0, 1500 - count(*)) AS free_rows FROM v GROUP BY 1")
def diag_free_space(spark, d):
    found = versions.block_statistics(_versions(spark, d), 1000)
    return found.select("block", F.greatest(F.lit(0), 1500 - F.col("live") - F.col("dead")).alias("free_rows"))


@query("lob_class", "SELECT doc_id, CASE WHEN strlen(text) + 4 <= 2048 THEN 'inline' ELSE 'lob' END AS storage FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def lob_class(spark, d):
    return table(spark, d, "documents").select("doc_id", lobs.storage(F.col("text")).alias("storage"))


@query("lob_fetch", "SELECT doc_id, md5(text) AS digest FROM documents")
def lob_fetch(spark, d):
    rows, far = lobs.split(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return lobs.fetch(rows, far, "text").select("doc_id", F.md5("text").alias("digest"))


@query("lob_orphans", "SELECT doc_id AS locator FROM documents WHERE strlen(text) + 4 > 2048 AND doc_id % 3 = 0")
def lob_orphans(spark, d):
    rows, far = lobs.split(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return lobs.orphans(far, rows.where("doc_id % 3 > 0")).select("locator")


@query("seq_next", "SELECT i AS n, 5 + 3 * (i - 1) AS value FROM range(1, 101) t(i)")
def seq_next(spark, d):
    return Sequence(increment=3, last_value=5).draw(spark, 100)


@query("seq_cycle", "SELECT i AS n, CASE WHEN i <= 4 THEN 7 + i - 1 ELSE 2 + (i - 5) % 9 END AS value FROM range(1, 41) t(i)")
def seq_cycle(spark, d):
    return Sequence(min_value=2, max_value=10, last_value=7, cycle=True).draw(spark, 40)


@query("seq_exhausted", "SELECT i AS n, CASE WHEN i <= 3 THEN 8 - 4 * (i - 1) END AS value FROM range(1, 6) t(i)")
def seq_exhausted(spark, d):
    return Sequence(increment=-4, min_value=0, max_value=10, last_value=8).draw(spark, 5)


@query("seq_cached", "SELECT 20::BIGINT AS last_value, true AS is_called")
def seq_cached(spark, d):
    return Sequence(cache=10).after(spark, 13).row(spark).select("last_value", "is_called")


@query("seq_row", "SELECT 9223372036854775000 AS last_value, true AS is_called, 5::BIGINT AS increment, -7::BIGINT AS min_value, 9223372036854775807 AS max_value, 1::BIGINT AS cache, false AS cycle")
def seq_row(spark, d):
    return Sequence(increment=5, min_value=-7).set(9223372036854775000).row(spark)


@query("seq_rows", "SELECT o_orderkey, 100 + 7 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS value FROM orders")
def seq_rows(spark, d):
    """A value of a sequence for every row of a table, in the table's order."""
    placed = running(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")])
    return placed.select("o_orderkey", Sequence(increment=7, last_value=100).value(F.col("position")).alias("value"))


def _requests(spark, d):
    """Lock requests made of orders: an object per customer, the first of each granted."""
    orders = table(spark, d, "orders")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("f"))
    mode = F.when(F.col("o_orderkey") % 3 == 0, "exclusive").when(F.col("o_orderkey") % 3 == 1, "share").otherwise("access share")
    return orders.join(first, "o_custkey").select((F.col("o_orderkey") % 40).alias("xid"), F.col("o_custkey").alias("object"), mode.alias("mode"), (F.col("o_orderkey") == F.col("f")).alias("granted"))


_WAITS = """WITH RECURSIVE r AS (SELECT o_orderkey % 40 AS xid, o_custkey AS object, o_orderkey % 3 AS m, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS granted FROM orders),
w AS (SELECT DISTINCT a.xid AS waiter, b.xid AS holder FROM r a JOIN r b ON a.object = b.object AND NOT a.granted AND b.granted AND a.xid <> b.xid WHERE a.m = 0 AND b.m < 2 OR a.m = 1 AND b.m = 0)"""


@query("lock_waits", f"{_WAITS} SELECT * FROM w")
def lock_waits(spark, d):
    return waits(_requests(spark, d))


@query("lock_deadlocks", f"{_WAITS}, reach(a, b) AS (SELECT waiter, holder FROM w UNION SELECT a, holder FROM reach JOIN w ON b = waiter), cyc AS (SELECT DISTINCT a FROM reach WHERE a = b) SELECT DISTINCT a AS waiter FROM reach WHERE a IN (FROM cyc) OR b IN (FROM cyc)")
def lock_deadlocks(spark, d):
    return deadlocked(waits(_requests(spark, d)))
