"""Queries of scalar functions over the tables and over small lists of special values."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators.order import running
from palimpsest.plans.register import Registry
from palimpsest.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _texts(values: list[str | None]) -> str:
    return ", ".join("(NULL)" if v is None else "('" + v.replace("'", "''") + "')" for v in values)


BOOLS = [" t ", "tr", "true", "TRUE", "y", "yes", "on", "o", "off", "of", "1", "0", "n", "no", "fals", "", " ", None, "10"]
INTS = ["12", " -7abc", "x9", "", "+3.5", None, "99999999999999999999"]
NETWORKS = ["10.0.0.0/8", "10.0.0.0/16", "10.1.2.3/16", "10.1.2.3", "9.255.0.0/16", "192.168.1.0/24"]


@query("bool_in", f"""SELECT x, CASE WHEN y <> '' AND (starts_with('true', y) OR starts_with('yes', y) OR y IN ('on', '1')) THEN true
WHEN y <> '' AND (starts_with('false', y) OR starts_with('no', y) OR y IN ('off', '0')) THEN false END AS value FROM (SELECT x, trim(x) AS y FROM (VALUES {_texts(BOOLS)}) t(x))""")
def bool_in(spark, d):
    return spark.createDataFrame([(v,) for v in BOOLS], "x string").select("x", scalars.bool_in(F.col("x")).alias("value"))


@query("bool_out", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 't' WHEN o_custkey % 3 = 1 THEN 'f' END AS shown FROM orders")
def bool_out(spark, d):
    flag = F.when(F.col("o_custkey") % 3 < 2, F.col("o_custkey") % 3 == 0)
    return table(spark, d, "orders").select("o_orderkey", scalars.bool_out(flag).alias("shown"))


@query("int_in", f"SELECT x, CASE WHEN x IS NOT NULL THEN coalesce(TRY_CAST(nullif(regexp_extract(x, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) END AS value FROM (VALUES {_texts(INTS)}) t(x)")
def int_in(spark, d):
    return spark.createDataFrame([(v,) for v in INTS], "x string").select("x", scalars.int_in(F.col("x")).alias("value"))


_FLOATS = "CASE c_custkey % 8 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN c_custkey * 1e15 WHEN 4 THEN c_custkey / 4096 WHEN 5 THEN 0 WHEN 6 THEN -c_custkey ELSE -c_custkey / 64 END"
_SHOWN = "CASE WHEN isnan(x) THEN 'NaN' WHEN isinf(x) THEN CASE WHEN x > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE printf('%.16g', x) END"


@query("float_out", f"SELECT c_custkey, {_SHOWN} AS shown, printf('%.7g', y) AS short FROM (SELECT c_custkey, {_FLOATS} AS x, c_custkey / 3.0::DOUBLE * ([1, 1e12, 1e-9, -1e3, 1e-4])[c_custkey % 5 + 1] AS y FROM customer)")
def float_out(spark, d):
    k, n = F.col("c_custkey") % 8, F.col("c_custkey").cast("double")
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, n * 1e15).when(k == 4, n / 4096).when(k == 5, 0.0).when(k == 6, -n).otherwise(-n / 64)
    y = n / 3.0 * F.element_at(F.array(*(F.lit(v) for v in (1.0, 1e12, 1e-9, -1e3, 1e-4))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", scalars.float_out(x).alias("shown"), scalars.float_out(y, scalars.FLOAT_DIGITS).alias("short"))


_TAILS = ["", "abc", "e2", " 7", "e", ".", "."]


@query("float_in", f"""SELECT c_custkey, CAST(coalesce(TRY_CAST(nullif(regexp_extract(x, '^\\s*([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0) AS DOUBLE) AS value, substr(x, 1, 1) AS first,
coalesce(TRY_CAST(nullif(regexp_extract(x, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) & 4294967295 AS oid
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'x' ELSE '' END || CAST(c_acctbal AS DECIMAL(18,2)) || ([{', '.join(f"'{t}'" for t in _TAILS)}])[c_custkey % 7 + 1] AS x FROM customer)""")
def float_in(spark, d):
    """Numbers that texts begin with: doubles, ids of 32 bits and first characters, after spaces and before whatever follows."""
    head = F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, "x").otherwise("")
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("c_custkey") % 7 + 1).cast("int"))
    x = F.concat(head, F.col("c_acctbal").cast("decimal(18,2)").cast("string"), tail)
    rows = table(spark, d, "customer").select("c_custkey", x.alias("x"))
    return rows.select("c_custkey", scalars.float_in(F.col("x")).alias("value"), scalars.char_in(F.col("x")).alias("first"), scalars.oid_in(F.col("x")).alias("oid"))


_SIDES = {  # name: Spark's two sides, DuckDB's two sides
    "int2": ("cast(l_linenumber as smallint)", "cast(l_suppkey % 8 as smallint)"), "int4": ("l_linenumber", "cast(l_suppkey % 8 as int)"), "int8": ("l_partkey % 100", "l_suppkey % 100"),
    "float4": ("cast(l_tax as float)", "cast(l_discount as float)"), "float8": ("l_tax", "l_discount"), "text": ("l_returnflag", "chr(65 + l_suppkey % 20)"),
    "bool": ("l_linestatus = 'O'", "l_tax > 0.04"), "char": ("l_linestatus", "chr(70 + l_suppkey % 10)"), "name": ("l_returnflag", "chr(65 + l_suppkey % 20)"), "oid": ("l_partkey % 100", "l_suppkey % 100"),
}
_OPS = {"lt": "<", "le": "<=", "eq": "=", "ge": ">=", "gt": ">"}


def _compared(wrap: str) -> list[tuple[str, str]]:
    return [(f"{kind}_{name}", wrap.format(f"({a}) {op} ({b})")) for kind, (a, b) in _SIDES.items() for name, op in _OPS.items() if name == "eq" or kind not in ("bool", "char", "name", "oid")]


@query("cmp_types", "SELECT " + ", ".join(f"{x} AS {n}" for n, x in _compared("count(*) FILTER ({})")) + " FROM (SELECT *, CAST(65 AS INTEGER) FROM (SELECT * REPLACE (CAST(l_suppkey AS INTEGER) AS l_suppkey) FROM lineitem))")
def cmp_types(spark, d):
    """Rows for which each comparison of each type holds: five of numbers and text, equality alone of the others."""
    return table(spark, d, "lineitem").agg(*(F.expr(x).alias(n) for n, x in _compared("count_if({})")))


@query("cmp_threeway", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a < b THEN -1 WHEN a = b THEN 0 WHEN a > b THEN 1 END AS cmp FROM
(SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_suppkey % 10, 4) AS a, l_linenumber AS b FROM lineitem)""")
def cmp_threeway(spark, d):
    a = F.nullif(F.col("l_suppkey") % 10, F.lit(4))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.three_way(a, F.col("l_linenumber")).alias("cmp"))


@query("cmp_cross_type", "SELECT count(*) FILTER (l_linenumber = l_suppkey % 8) AS int_long, count(*) FILTER (l_quantity = l_linenumber) AS double_int, count(*) FILTER (CAST(l_shipdate AS DATE) = l_shipdate) AS date_ts FROM lineitem")
def cmp_cross_type(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count_if(F.col("l_linenumber") == F.col("l_suppkey") % 8).alias("int_long"), F.count_if(F.col("l_quantity") == F.col("l_linenumber")).alias("double_int"),
        F.count_if(scalars.date_to_timestamp(F.col("l_shipdate").cast("date")) == F.col("l_shipdate")).alias("date_ts"))


@query("cmp_nan", "SELECT c_custkey, row_number() OVER (ORDER BY x, c_custkey) AS position FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'nan'::DOUBLE ELSE c_acctbal END AS x FROM customer)")
def cmp_nan(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("x"))
    return running(rows, [F.col("x"), F.col("c_custkey")]).select("c_custkey", "position")


@query("interval_order", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey * 1000000 + (l_linenumber * 30 + l_suppkey) * 86400000000 AS span FROM lineitem""")
def interval_order(spark, d):
    span = scalars.interval_span(F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_orderkey") * 1_000_000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", span.alias("span"))


@query("vector_order", """SELECT o_custkey, array_to_string(v, ',') AS v, row_number() OVER (ORDER BY len(v), v, o_custkey) AS position FROM (SELECT o_custkey, list_sort(list_distinct(list(o_orderkey % 11))) AS v FROM orders GROUP BY o_custkey)""")
def vector_order(spark, d):
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 11)).alias("v"))
    return running(rows.withColumn("k", scalars.vector_order(F.col("v"))), [F.col("k"), F.col("o_custkey")]).select("o_custkey", F.array_join("v", ",").alias("v"), "position")


@query("inet_order", "SELECT x, CAST(position AS BIGINT) AS position FROM (VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(["9.255.0.0/16", "10.0.0.0/8", "10.0.0.0/16", "10.1.2.3/16", "10.1.2.3", "192.168.1.0/24"], 1)) + ") t(x, position)")
def inet_order(spark, d):
    rows = spark.createDataFrame([(x,) for x in NETWORKS], "x string").withColumn("k", scalars.inet_order(F.col("x")))
    return running(rows, [F.col("k")]).select("x", "position")


@query("timetz_order", "SELECT event_id, (event_id % 86400) * 1000000 + (event_id % 24 - 12) * 3600 * 1000000 AS utc FROM events")
def timetz_order(spark, d):
    k = scalars.timetz_order(F.col("event_id") % 86400 * 1_000_000, (F.col("event_id") % 24 - 12) * 3600)
    return table(spark, d, "events").select("event_id", k["utc"].alias("utc"))


@query("text_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS position, substr(p_name, 1, 5) AS name FROM part")
def text_order(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return running(rows, [F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "position", scalars.name_in(F.col("p_name"), 5).alias("name"))


@query("tuple_default", "SELECT n_nationkey, n_name, 'none' AS added FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 15 THEN 'set' END FROM nation WHERE n_nationkey >= 10")
def tuple_default(spark, d):
    old = table(spark, d, "nation").where("n_nationkey < 10").select("n_nationkey", "n_name")
    new = table(spark, d, "nation").where("n_nationkey >= 10").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") < 15, "set").alias("added"))
    return old.withColumn("added", F.lit("none")).unionByName(new)


@query("tuple_modify", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS s_name, s_acctbal FROM supplier")
def tuple_modify(spark, d):
    changed = F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
    return table(spark, d, "supplier").withColumn("s_name", changed).select("s_suppkey", "s_name", "s_acctbal")


@query("tuple_equal", "SELECT count(*) AS n FROM (SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)")
def tuple_equal(spark, d):
    rows = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("r"))
    return rows.groupBy("r").agg(F.count("*").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("n"))


@query("array_items", "SELECT o_custkey, len(list(o_orderkey)) AS n, unnest(list_sort(list(o_orderkey))) AS item FROM orders GROUP BY o_custkey")
def array_items(spark, d):
    held = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("a"))
    return held.select("o_custkey", F.size("a").cast("long").alias("n"), F.explode("a").alias("item"))
