"""Queries of scans, index operators, sorts and plain aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import aggregates, index
from palimpsest.operators.order import first_row, key, running
from palimpsest.operators.scan import Key, block_of, fetch, sample_blocks, scan, simplify
from palimpsest.operators.versions import Snapshot
from palimpsest.plans.register import Registry
from palimpsest.sources.tables import VERSIONS_SQL, order_versions, relations, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity"
LINE_COLUMNS = LINE.split(", ")
KEYED = [Key("l_returnflag", "=", "R"), Key("l_quantity", ">=", 45.0), Key("l_linestatus", "=", "F")]


@query("scan_full", "SELECT * FROM supplier")
def scan_full(spark, d):
    return scan(table(spark, d, "supplier"))


@query("scan_keyed", f"SELECT {LINE} FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_linestatus = 'F'")
def scan_keyed(spark, d):
    return scan(table(spark, d, "lineitem"), KEYED, LINE_COLUMNS)


@query("scan_rescan", f"SELECT {LINE} FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_linestatus = 'F'), range(2)")
def scan_rescan(spark, d):
    once = scan(table(spark, d, "lineitem"), KEYED, LINE_COLUMNS)
    return once.unionByName(once)


@query("scan_null_key", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 4 AND o_custkey % 10 <= 2")
def scan_null_key(spark, d):
    """A null argument meets no row, and a null column meets no comparison."""
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 10, F.lit(4)).alias("k"))
    return scan(rows, [Key("k", "=", None)], ["o_orderkey"]).unionByName(scan(rows, [Key("k", "<=", 2)], ["o_orderkey"]))


@query("scan_project", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def scan_project(spark, d):
    return scan(table(spark, d, "lineitem"), columns=["l_orderkey", "l_extendedprice"])


@query("scan_parallel", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def scan_parallel(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("scan_block_sample", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey // 100 IN (3, 17, 42, 99)")
def scan_block_sample(spark, d):
    return sample_blocks(table(spark, d, "orders"), "o_orderkey", 100, [3, 17, 42, 99]).select("o_orderkey", "o_custkey")


@query("page_rows", f"{VERSIONS_SQL} SELECT _rid // 50 AS block, string_agg(CAST(_rid % 50 AS VARCHAR), ',' ORDER BY _rid % 50) AS offsets FROM v WHERE coalesce(_begin_csn < 60, false) AND NOT coalesce(_end_csn < 60, false) GROUP BY 1")
def page_rows(spark, d):
    """The places in each block of the versions that a snapshot sees; a block has 50 rows at most."""
    rows = order_versions(table(spark, d, "orders")).where(Snapshot(60).visible())
    offsets = F.array_join(F.array_sort(F.collect_list(F.col("_rid") % 50)), ",")
    return rows.groupBy(block_of(F.col("_rid"), 50).alias("block")).agg(offsets.alias("offsets"))


@query("fetch_by_rid", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def fetch_by_rid(spark, d):
    rids = scan(table(spark, d, "lineitem"), [Key("l_quantity", "=", 50.0)]).select(F.col("l_orderkey").alias("o_orderkey"))
    return fetch(table(spark, d, "orders"), rids, "o_orderkey").select("o_orderkey", "o_totalprice")


_CATALOG = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}


@query("catalog_scan", f"""SELECT table_name AS relation, CAST(ordinal_position AS INTEGER) AS attno, column_name AS attname, CASE {' '.join(f"WHEN data_type LIKE '{a}%' THEN '{b}'" for a, b in _TYPES.items())} END AS atttype
FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{n}'" for n in _CATALOG)})""")
def catalog_scan(spark, d):
    return relations(spark, d, _CATALOG)


@query("idx_prefix_eq", f"SELECT {LINE} FROM lineitem WHERE l_partkey = 77 OR l_partkey = 78 AND l_suppkey >= 4 OR l_partkey = 79 AND l_suppkey IN (SELECT max(l_suppkey) FROM lineitem WHERE l_partkey = 79)")
def idx_prefix_eq(spark, d):
    """Equal prefixes of the index on part and supplier: the first column alone, with a bound on the second, and both."""
    lines = table(spark, d, "lineitem")
    last = lines.where("l_partkey = 79").agg(F.max("l_suppkey")).first()[0]
    cases = [[Key("l_partkey", "=", 77)], [Key("l_partkey", "=", 78), Key("l_suppkey", ">=", 4)], [Key("l_partkey", "=", 79), Key("l_suppkey", "=", last)]]
    one, two, three = (scan(lines, keys, LINE_COLUMNS) for keys in cases)
    return one.unionByName(two).unionByName(three)


@query("idx_range", f"SELECT {LINE} FROM lineitem WHERE l_orderkey > 100 AND l_orderkey <= 400")
def idx_range(spark, d):
    keys, _ = simplify([Key("l_orderkey", ">", 50), Key("l_orderkey", ">", 100), Key("l_orderkey", "<=", 400), Key("l_orderkey", "<", 1000)])
    return scan(table(spark, d, "lineitem"), keys, LINE_COLUMNS)


@query("idx_in_list", "SELECT row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity) AS position, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (5, 9, 300)")
def idx_in_list(spark, d):
    found = scan(table(spark, d, "lineitem"), [Key("l_partkey", "in", [300, None, 5, 9, 5])], LINE_COLUMNS)
    return running(found, [key("l_partkey"), key("l_orderkey"), key("l_linenumber"), key("l_quantity")])


@query("idx_in_lists", """SELECT row_number() OVER (ORDER BY l_linenumber, l_partkey, l_orderkey, l_quantity) AS position, l_linenumber, l_partkey, l_orderkey, l_quantity FROM lineitem
WHERE l_linenumber IN (2, 3, 5) AND l_partkey IN (7, 9, 31, 300)""")
def idx_in_lists(spark, d):
    """Two lists over an index on line number and part: rows come in its order, in which the last list varies fastest."""
    found = scan(table(spark, d, "lineitem"), [Key("l_linenumber", "in", [5, 3, None, 2, 3]), Key("l_partkey", "= any", [300, 9, 7, 31, None])], ["l_linenumber", "l_partkey", "l_orderkey", "l_quantity"])
    return running(found, [key("l_linenumber"), key("l_partkey"), key("l_orderkey"), key("l_quantity")])


@query("idx_scan_fetch", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey BETWEEN 20 AND 60 AND o_orderstatus <> 'P'")
def idx_scan_fetch(spark, d):
    """An index scan whose row ids fetch the rows, which are then judged by a column that the index lacks."""
    orders = table(spark, d, "orders")
    index_rows = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("_rid"))
    rids = scan(index_rows, [Key("k", ">=", 20), Key("k", "<=", 60)], ["_rid"]).withColumnRenamed("_rid", "o_orderkey")
    return fetch(orders, rids, "o_orderkey").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("idx_lt_any", "SELECT o_orderkey FROM orders WHERE o_orderkey < 90 AND o_custkey > 200")
def idx_lt_any(spark, d):
    return scan(table(spark, d, "orders"), [Key("o_orderkey", "< any", [3, None, 90, 40]), Key("o_custkey", "> any", [700, 200])], ["o_orderkey"])


@query("idx_null_search", """WITH n AS (SELECT o_orderkey, nullif(o_custkey % 7, 3) AS a, nullif(o_orderkey % 5, 2) AS b FROM orders)
SELECT 'a null' AS which, o_orderkey FROM n WHERE a IS NULL AND b = 1 UNION ALL SELECT 'b null', o_orderkey FROM n WHERE a = 4 AND b IS NULL
UNION ALL SELECT 'none', o_orderkey FROM n WHERE a IS NOT NULL AND b IS NOT NULL""")
def idx_null_search(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(3)).alias("a"), F.nullif(F.col("o_orderkey") % 5, F.lit(2)).alias("b"))
    cases = {"a null": [Key("a", "is null"), Key("b", "=", 1)], "b null": [Key("a", "=", 4), Key("b", "is null")], "none": [Key("a", "is not null"), Key("b", "is not null")]}
    parts = [scan(rows, keys).select(F.lit(name).alias("which"), "o_orderkey") for name, keys in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("idx_backward", "SELECT row_number() OVER (ORDER BY nullif(o_custkey % 50, 7) DESC NULLS FIRST, o_orderkey DESC) AS position, o_orderkey, nullif(o_custkey % 50, 7) AS k FROM orders")
def idx_backward(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("k"))
    return running(rows, [key("k", desc=True, nulls_first=True), key("o_orderkey", desc=True, nulls_first=True)])


@query("idx_full", "SELECT row_number() OVER (ORDER BY p_size, p_partkey) AS position, p_size, p_partkey FROM part")
def idx_full(spark, d):
    return running(table(spark, d, "part").select("p_size", "p_partkey"), [key("p_size"), key("p_partkey")])


@query("idx_only", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey < 20")
def idx_only(spark, d):
    return scan(table(spark, d, "lineitem"), [Key("l_suppkey", "<", 20)], ["l_suppkey", "l_partkey"]).distinct()


@query("idx_point", "SELECT * FROM customer WHERE c_custkey = 42")
def idx_point(spark, d):
    return scan(table(spark, d, "customer"), [Key("c_custkey", "=", 42)]).limit(1)


@query("idx_conflict", "SELECT o_orderkey, 'merged' AS which FROM orders WHERE o_orderkey = 7 UNION ALL SELECT o_orderkey, 'between' FROM orders WHERE o_orderkey > 20 AND o_orderkey < 30")
def idx_conflict(spark, d):
    """Several keys on one column: those that agree are merged and those that contradict each other give no rows."""
    cases = {"conflict": [("=", 1), (">", 2)], "merged": [("=", 7), ("<=", 7), (">", 2)], "between": [(">", 20), (">=", 5), ("<", 30)], "apart": [("<", 5), ("is null", None)], "twice": [("=", 3), ("=", 4)]}
    parts = []
    for which, given in cases.items():
        keys, conflict = simplify([Key("o_orderkey", op, value) for op, value in given])
        rows = table(spark, d, "orders").where(F.lit(False)) if conflict else scan(table(spark, d, "orders"), keys)
        parts.append(rows.select("o_orderkey", F.lit(which).alias("which")))
    return reduce(DataFrame.unionByName, parts)


@query("idx_build", "SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) AS position, c_nationkey AS k, c_custkey AS _rid FROM customer")
def idx_build(spark, d):
    return running(index.build(table(spark, d, "customer"), {"k": F.col("c_nationkey")}, "c_custkey"), [key("k"), key("_rid")])


@query("idx_build_dups", """SELECT k, count(*) AS n, min(o_orderkey) AS first_rid, max(o_orderkey) AS last_rid FROM (SELECT nullif(o_custkey, 5) AS k, o_orderkey FROM orders)
WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1""")
def idx_build_dups(spark, d):
    built = index.build(table(spark, d, "orders"), {"k": F.nullif(F.col("o_custkey"), F.lit(5))}, "o_orderkey")
    return index.duplicates(built, ["k"])


@query("idx_expr", "SELECT upper(substr(c_mktsegment, 1, 3)) AS k, c_custkey AS _rid FROM customer WHERE upper(substr(c_mktsegment, 1, 3)) = 'AUT'")
def idx_expr(spark, d):
    built = index.build(table(spark, d, "customer"), {"k": F.upper(F.substring("c_mktsegment", 1, 3))}, "c_custkey")
    return scan(built, [Key("k", "=", "AUT")])


@query("idx_part_counts", "SELECT CAST(o_orderstatus AS VARCHAR) AS part, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM orders")
def idx_part_counts(spark, d):
    return index.partition_counts(table(spark, d, "orders"), "o_orderstatus")


@query("idx_partition", "SELECT o_custkey AS k, o_orderkey AS _rid, o_orderstatus AS part FROM orders WHERE o_orderstatus <> 'P'")
def idx_partition(spark, d):
    orders = table(spark, d, "orders")
    built = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("_rid"), F.col("o_orderstatus").alias("part"))
    live = spark.createDataFrame([("F",), ("O",)], "part string")
    return index.keep_live_partitions(built, "part", live)


_DELTA = "SELECT o_custkey AS k, o_orderkey AS _rid, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'DELETE' ELSE 'INSERT' END AS op FROM orders WHERE o_orderkey % 4 = 0"


@query("idx_delta_merge", f"""WITH base AS (SELECT o_custkey AS k, o_orderkey AS _rid FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 > 0), delta AS ({_DELTA} UNION ALL
SELECT o_custkey, o_orderkey, o_orderkey + 100000, 'DELETE' FROM orders WHERE o_orderkey % 28 = 0),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, _rid ORDER BY seq DESC) AS n FROM delta) WHERE n = 1)
SELECT k, _rid FROM base WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.k = base.k AND last._rid = base._rid) UNION ALL SELECT k, _rid FROM last WHERE op = 'INSERT'""")
def idx_delta_merge(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("_rid"))
    base = rows.where("_rid % 2 = 0 and _rid % 5 > 0")
    first = rows.where("_rid % 4 = 0").select("*", F.col("_rid").alias("seq"), F.when(F.col("_rid") % 3 == 0, "DELETE").otherwise("INSERT").alias("op"))
    second = rows.where("_rid % 28 = 0").select("*", (F.col("_rid") + 100000).alias("seq"), F.lit("DELETE").alias("op"))
    return index.merge_delta(base, first.unionByName(second), ["k"])


@query("idx_unique_check", """WITH there AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey < 300), fresh AS (SELECT nullif(o_custkey % 400, 9) AS k, o_orderkey AS _rid FROM orders WHERE o_orderkey >= 14000)
SELECT k, _rid, k IS NULL OR (k NOT IN (SELECT k FROM there) AND row_number() OVER (PARTITION BY k ORDER BY _rid) = 1) AS satisfies_unique FROM fresh""")
def idx_unique_check(spark, d):
    orders = table(spark, d, "orders")
    there = orders.where("o_orderkey < 300").select(F.col("o_custkey").alias("k"))
    new = orders.where("o_orderkey >= 14000").select(F.nullif(F.col("o_custkey") % 400, F.lit(9)).alias("k"), F.col("o_orderkey").alias("_rid"))
    return index.insert_verdicts(there, new, ["k"])


@query("idx_delete", "SELECT o_custkey AS k, o_orderkey AS _rid FROM orders WHERE o_orderstatus <> 'F'")
def idx_delete(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("_rid"), "o_orderstatus")
    return index.remove(rows.drop("o_orderstatus"), rows.where("o_orderstatus = 'F'"), ["k"])


@query("sort_multi", "SELECT row_number() OVER (ORDER BY c_mktsegment DESC NULLS LAST, c_acctbal ASC NULLS FIRST, c_custkey) AS position, c_mktsegment, c_acctbal, c_custkey FROM customer")
def sort_multi(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_acctbal", "c_custkey")
    return running(rows, [key("c_mktsegment", desc=True), key("c_acctbal", nulls_first=True), key("c_custkey")])


@query("sort_partition_ties", "SELECT row_number() OVER (ORDER BY o_custkey, o_orderstatus, o_orderkey) AS position, o_custkey, o_orderstatus, o_orderkey FROM orders")
def sort_partition_ties(spark, d):
    return running(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), [key("o_custkey"), key("o_orderstatus"), key("o_orderkey")])


@query("sort_first", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1")
def sort_first(spark, d):
    return first_row(scan(table(spark, d, "orders"), [Key("o_orderstatus", "=", "O")], ["o_orderkey", "o_custkey"]), [key("o_orderkey")])


@query("sort_list", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderkey % 13))), ',') AS sorted FROM orders GROUP BY o_custkey")
def sort_list(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("o_orderkey") % 13)), ",").alias("sorted"))


@query("agg_count", "SELECT count(*) AS n FROM lineitem WHERE l_partkey = 100")
def agg_count(spark, d):
    return aggregates.count_rows(table(spark, d, "lineitem"), [Key("l_partkey", "=", 100)])


@query("agg_sum_range", "SELECT CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(28,6))), 0) AS DOUBLE) AS total FROM lineitem WHERE l_orderkey >= 10 AND l_orderkey < 5000 AND l_returnflag = 'R'")
def agg_sum_range(spark, d):
    keys = [Key("l_orderkey", ">=", 10), Key("l_orderkey", "<", 5000), Key("l_returnflag", "=", "R")]
    return aggregates.sum_or_zero(table(spark, d, "lineitem"), keys, "l_extendedprice")


@query("agg_sum_empty", "SELECT coalesce(sum(l_extendedprice), 0.0::DOUBLE) AS total FROM lineitem WHERE l_orderkey < 0")
def agg_sum_empty(spark, d):
    return aggregates.sum_or_zero(table(spark, d, "lineitem"), [Key("l_orderkey", "<", 0)], "l_extendedprice")


@query("agg_min_row", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal, c_custkey LIMIT 1")
def agg_min_row(spark, d):
    return aggregates.extreme_row(table(spark, d, "customer"), [Key("c_nationkey", "=", 3)], "c_acctbal", ["c_custkey", "c_name", "c_acctbal"], largest=False)


@query("agg_max_row", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1")
def agg_max_row(spark, d):
    return aggregates.extreme_row(table(spark, d, "customer"), [Key("c_nationkey", "=", 3)], "c_acctbal", ["c_custkey", "c_name", "c_acctbal"], largest=True)


@query("agg_txn_mix", """SELECT event_type AS kind, count(*) FILTER (user_id % 10 > 0) AS committed, count(*) FILTER (user_id % 10 = 0) AS aborted,
round(100.0::DOUBLE * count(*) FILTER (user_id % 10 = 0) / count(*), 4) AS aborted_pct FROM events GROUP BY event_type""")
def agg_txn_mix(spark, d):
    return aggregates.outcome_rates(table(spark, d, "events"), F.col("event_type"), F.col("user_id") % 10 > 0)


@query("agg_distinct", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey < 200")
def agg_distinct(spark, d):
    return scan(table(spark, d, "lineitem"), [Key("l_orderkey", "<", 200)], ["l_partkey"]).distinct()
