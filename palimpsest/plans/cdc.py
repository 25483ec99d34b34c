"""Queries of change data capture over change records made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.plans.register import Registry
from palimpsest.sources.tables import CHANGES_SQL, event_changes, table
from palimpsest.streaming import cdc

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

COLUMNS = {"user_id": "bigint", "event_type": "text", "cents": "bigint"}
_ORDERED = f"""{CHANGES_SQL}, o AS (SELECT xid, csn, n AS n_changes, row_number() OVER (ORDER BY csn) AS position,
CAST(coalesce(sum(n + 2) OVER (ORDER BY csn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM t WHERE NOT aborted)"""


def _changes(spark, d):
    return event_changes(table(spark, d, "events"))


@query("cdc_reassemble", f"{CHANGES_SQL} SELECT xid, lsn, op, row_number() OVER (PARTITION BY xid ORDER BY lsn) AS nth FROM c")
def cdc_reassemble(spark, d):
    return cdc.reassemble(_changes(spark, d)).select("xid", "lsn", "op", "nth")


@query("cdc_commit_order", f"{_ORDERED} SELECT * FROM o")
def cdc_commit_order(spark, d):
    return cdc.in_commit_order(cdc.commits(_changes(spark, d))).select("xid", "csn", "n_changes", "position", "before")


@query("cdc_slot_skip", f"{CHANGES_SQL} SELECT xid, csn FROM t WHERE NOT aborted AND csn > 4000")
def cdc_slot_skip(spark, d):
    return cdc.after_slot(cdc.commits(_changes(spark, d)), 4000).select("xid", "csn")


@query("cdc_upto_n", f"{_ORDERED} SELECT xid, csn, before FROM o WHERE before < 100")
def cdc_upto_n(spark, d):
    return cdc.up_to(cdc.in_commit_order(cdc.commits(_changes(spark, d))), n_rows=100).select("xid", "csn", "before")


@query("cdc_upto_csn", f"{CHANGES_SQL} SELECT xid, csn FROM t WHERE NOT aborted AND csn <= 1234")
def cdc_upto_csn(spark, d):
    return cdc.up_to(cdc.commits(_changes(spark, d)), csn=1234).select("xid", "csn")


@query("cdc_text", f"""{CHANGES_SQL}, k AS (SELECT t.csn, c.xid, row_number() OVER (PARTITION BY c.xid ORDER BY lsn) AS line, t.n, op,
'user_id[bigint]:' || user_id || ' event_type[text]:''' || event_type || ''' cents[bigint]:' || cents AS new, 'user_id[bigint]:' || user_id AS old FROM c JOIN t USING (xid) WHERE NOT t.aborted)
SELECT csn, xid, CAST(line AS INTEGER) AS line, 'table public.events ' || op || ': ' || CASE op WHEN 'INSERT' THEN new WHEN 'UPDATE' THEN 'old-key: ' || old || ' new-tuple: ' || new ELSE old END AS text FROM k
UNION ALL SELECT csn, xid, 0, 'BEGIN ' || xid FROM t WHERE NOT aborted UNION ALL SELECT csn, xid, CAST(n + 1 AS INTEGER), 'COMMIT ' || xid FROM t WHERE NOT aborted""")
def cdc_text(spark, d):
    changes = _changes(spark, d)
    return cdc.decode(changes, cdc.commits(changes), cdc.text_plugin("public.events", COLUMNS, ["user_id"]))


@query("cdc_text_options", f"""{CHANGES_SQL}, e AS (SELECT xid, csn, n FROM t WHERE NOT aborted AND xid % 4 > 0), k AS (SELECT csn, xid, row_number() OVER (PARTITION BY xid ORDER BY lsn) AS line, op, nullif(user_id, user_id // 3 * 3) AS u, nullif(event_type, 'click') AS e, cents
FROM c JOIN e USING (xid)), s AS (SELECT *, 'user_id[bigint]:' || u AS old, concat_ws(' ', 'user_id[bigint]:' || u, 'event_type[text]:' || chr(39) || e || chr(39), 'cents[bigint]:' || cents) AS new FROM k)
SELECT csn, xid, CAST(line AS INTEGER) AS line, 'table public.events ' || op || ': ' || CASE op WHEN 'INSERT' THEN new WHEN 'UPDATE' THEN 'old-key: ' || coalesce(old, '') || ' new-tuple: ' || new ELSE coalesce(old, '(no-tuple-data)') END AS text FROM s
UNION ALL SELECT csn, xid, 0, 'BEGIN' FROM e UNION ALL SELECT csn, xid, CAST(n + 1 AS INTEGER), 'COMMIT' FROM e""")
def cdc_text_options(spark, d):
    """Without xids, and without the columns that are null; a deletion whose key is null has no tuple. Empty transactions give nothing."""
    changes = _changes(spark, d)
    committed = cdc.commits(changes).where("xid % 4 > 0").unionByName(spark.createDataFrame([(-1, -1, 0)], "xid long, csn long, n_changes long"))
    changes = changes.withColumn("user_id", F.nullif("user_id", F.floor(F.col("user_id") / 3) * 3)).withColumn("event_type", F.nullif("event_type", F.lit("click")))
    return cdc.decode(changes, committed, cdc.text_plugin("public.events", COLUMNS, ["user_id"], include_xids=False, skip_nulls=True), skip_empty=True)


_DICTIONARY = [(0, -1, "a1"), (0, 3000, "a2"), (0, 7000, "a3"), (1, 0, "b1"), (1, 3001, "b2"), (1, 3004, "b3"), (2, -5, "c1")]


@query("cdc_schema_asof", f"""{CHANGES_SQL}, d AS (SELECT * FROM (VALUES {', '.join(f"({t}, {n}, '{x}')" for t, n, x in _DICTIONARY)}) d(t, n, x))
SELECT lsn, lsn % 3 AS table_id, max(n) AS table_csn, arg_max(x, n) AS definition FROM c JOIN d ON t = lsn % 3 AND n < lsn GROUP BY lsn""")
def cdc_schema_asof(spark, d):
    dictionary = spark.createDataFrame(_DICTIONARY, "table_id long, table_csn int, definition string")
    return cdc.with_schema_version(_changes(spark, d).withColumn("table_id", F.col("lsn") % 3), dictionary).select("lsn", "table_id", "table_csn", "definition")


@query("cdc_apply", f"""{CHANGES_SQL}, l AS (SELECT c.*, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) AS k FROM c JOIN t USING (xid) WHERE NOT t.aborted)
SELECT user_id, event_type, cents, lsn FROM l WHERE k = 1 AND op <> 'DELETE'""")
def cdc_apply(spark, d):
    changes = _changes(spark, d).withColumn("at", F.col("lsn"))
    return cdc.apply_changes(changes, cdc.commits(changes), "user_id", ["event_type", "cents", "at"]).withColumnRenamed("at", "lsn")
