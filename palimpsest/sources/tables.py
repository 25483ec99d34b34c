"""Sources: the Parquet tables of a folder, and versioned rows and change records derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relations(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """A catalogue: (relation, attno, attname, atttype), a row per column, from the files' schemas."""
    rows = [(n, i, f.name, f.dataType.simpleString()) for n in names for i, f in enumerate(table(spark, sf_dir, n).schema.fields, 1)]
    return spark.createDataFrame(rows, "relation string, attno int, attname string, atttype string")


def order_versions(orders: DataFrame) -> DataFrame:
    """Versioned rows made of orders: status P isn't committed, every tenth key was updated, other fifth ones deleted."""
    key, live = F.col("o_orderkey"), F.col("o_orderstatus") != "P"
    begin, end = key % 97 + 1, F.when(live & (key % 5 == 0), key % 97 + 11)
    payload = ["o_custkey", "o_totalprice"]
    first = orders.select(
        key.alias("_rid"), F.lit(1).alias("_ver"), begin.alias("_begin_xid"), F.when(live, begin).alias("_begin_csn"), (key % 3).alias("_begin_cid"),
        end.alias("_end_xid"), end.alias("_end_csn"), F.when(end.isNotNull(), key % 2).alias("_end_cid"), *payload)
    none = F.lit(None).cast("long")
    second = orders.where(live & (key % 10 == 0)).select(
        key.alias("_rid"), F.lit(2).alias("_ver"), (key % 97 + 11).alias("_begin_xid"), (key % 97 + 11).alias("_begin_csn"), (key % 2).alias("_begin_cid"),
        none.alias("_end_xid"), none.alias("_end_csn"), none.alias("_end_cid"), "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return first.unionByName(second)


#: The same rows for DuckDB, as the beginning of a query.
VERSIONS_SQL = """WITH v AS (
SELECT o_orderkey AS _rid, 1 AS _ver, o_orderkey % 97 + 1 AS _begin_xid, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 97 + 1 END AS _begin_csn, o_orderkey % 3 AS _begin_cid,
       CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 = 0 THEN o_orderkey % 97 + 11 END AS _end_xid, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 = 0 THEN o_orderkey % 97 + 11 END AS _end_csn,
       CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 = 0 THEN o_orderkey % 2 END AS _end_cid, o_custkey, o_totalprice FROM orders
UNION ALL
SELECT o_orderkey, 2, o_orderkey % 97 + 11, o_orderkey % 97 + 11, o_orderkey % 2, NULL, NULL, NULL, o_custkey, o_totalprice + 1 FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 = 0)"""


def event_changes(events: DataFrame) -> DataFrame:
    """Change records made of events: seven changes a transaction, five transactions interleaved, every eleventh aborted."""
    i = F.col("event_id")
    xid = i % 5 + 5 * F.expr("event_id div 35")
    op = F.when(F.col("event_type").isin("signup", "click"), "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return events.select(i.alias("lsn"), xid.alias("xid"), op.alias("op"), (xid % 11 == 3).alias("aborted"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


CHANGES_SQL = """WITH c AS (
SELECT event_id AS lsn, event_id % 5 + 5 * (event_id // 35) AS xid, CASE WHEN event_type IN ('signup', 'click') THEN 'INSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
       (event_id % 5 + 5 * (event_id // 35)) % 11 = 3 AS aborted, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
t AS (SELECT xid, max(lsn) AS csn, count(*) AS n, bool_or(aborted) AS aborted FROM c GROUP BY xid)"""
