"""Queries that reconcile tables with each other: the seven consistency conditions and the stock level."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators.aggregates import reconcile
from palimpsest.plans.register import Registry
from palimpsest.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("check_1", """WITH n AS (SELECT n_regionkey AS w, n_nationkey, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS ytd FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
w AS (SELECT n_regionkey AS w, sum(CAST(c_acctbal AS DECIMAL(18,2))) + CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END AS w_ytd FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey),
s AS (SELECT w, sum(ytd) AS d_ytd FROM n GROUP BY w)
SELECT w, CAST(w_ytd AS DOUBLE) AS w_ytd, CAST(d_ytd AS DOUBLE) AS d_ytd, abs(w_ytd - d_ytd) <= 0.01 AS ok FROM w JOIN s USING (w)""")
def check_1(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("w"), "n_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("x"))
    stored = joined.groupBy("w").agg(F.sum("x").alias("x")).select("w", (F.col("x") + F.when(F.col("w") == 2, 1).otherwise(0)).alias("w_ytd"))
    summed = joined.groupBy("w", "n_nationkey").agg(F.sum("x").alias("x")).groupBy("w").agg(F.sum("x").alias("d_ytd"))
    return reconcile(stored, summed, ["w"], "w_ytd", "d_ytd", 0.01).withColumns({c: F.col(c).cast("double") for c in ("w_ytd", "d_ytd")})


@query("check_2", """WITH d AS (SELECT o_custkey % 50 AS district, max(o_orderkey) + 1 AS next_o FROM orders WHERE o_orderkey % 9 > 0 GROUP BY 1), o AS (SELECT o_custkey % 50 AS district, max(o_orderkey) AS max_o FROM orders GROUP BY 1),
n AS (SELECT o_custkey % 50 AS district, max(o_orderkey) AS max_no FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT district, next_o, max_o, max_no, next_o - 1 = max_o AND (max_no IS NULL OR max_o = max_no) AS ok FROM d LEFT JOIN o USING (district) LEFT JOIN n USING (district)""")
def check_2(spark, d):
    orders = table(spark, d, "orders").withColumn("district", F.col("o_custkey") % 50)
    every = orders.groupBy("district").agg((F.max(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey"))) + 1).alias("next_o"), F.max("o_orderkey").alias("max_o"),
                                           F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("max_no"))
    ok = (F.col("next_o") - 1 == F.col("max_o")) & (F.col("max_no").isNull() | (F.col("max_o") == F.col("max_no")))
    return every.where("next_o is not null").withColumn("ok", ok)


@query("check_3", "SELECT l_orderkey, max(l_linenumber) AS most, min(l_linenumber) AS least, count(*) AS n, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS ok FROM lineitem GROUP BY l_orderkey")
def check_3(spark, d):
    found = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("most"), F.min("l_linenumber").alias("least"), F.count("*").alias("n"))
    return found.withColumn("ok", F.col("most") - F.col("least") + 1 == F.col("n"))


_COUNTED = "SELECT o_orderkey, o_custkey % 100 AS district, o_orderkey % 7 + 1 AS ol_cnt FROM orders"


@query("check_4", f"""WITH o AS (SELECT district, CAST(sum(ol_cnt) AS BIGINT) AS ol_cnt FROM ({_COUNTED}) GROUP BY 1),
l AS (SELECT o_custkey % 100 AS district, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT coalesce(o.district, l.district) AS district, coalesce(ol_cnt, 0) AS ol_cnt, coalesce(n_lines, 0) AS n_lines, coalesce(ol_cnt, 0) = coalesce(n_lines, 0) AS ok FROM o FULL JOIN l USING (district)""")
def check_4(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("district"), (F.col("o_orderkey") % 7 + 1).alias("ol_cnt"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return reconcile(orders.groupBy("district").agg(F.sum("ol_cnt").alias("ol_cnt")), lines.groupBy("district").agg(F.sum("n").alias("n_lines")), ["district"], "ol_cnt", "n_lines")


@query("check_5", """WITH o AS (SELECT o_orderkey, nullif(o_custkey % 4, 0) AS carrier FROM orders), n AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'O')
SELECT o.o_orderkey, carrier IS NULL AS undelivered, n.o_orderkey IS NOT NULL AS is_new FROM o LEFT JOIN n ON o.o_orderkey = n.o_orderkey WHERE (carrier IS NULL) <> (n.o_orderkey IS NOT NULL)""")
def check_5(spark, d):
    orders = table(spark, d, "orders")
    new = orders.where("o_orderstatus = 'O'").select("o_orderkey").distinct().withColumn("_new", F.lit(True))
    both = orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 4, F.lit(0)).isNull().alias("undelivered")).join(new, "o_orderkey", "left")
    return both.select("o_orderkey", "undelivered", F.col("_new").isNotNull().alias("is_new")).where("undelivered <> is_new")


@query("check_6", f"""SELECT o_orderkey, ol_cnt, coalesce(n_lines, 0) AS n_lines, ol_cnt = coalesce(n_lines, 0) AS ok FROM ({_COUNTED}) LEFT JOIN
(SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey)""")
def check_6(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("ol_cnt"))
    found = orders.join(lines, "o_orderkey", "left").select("o_orderkey", "ol_cnt", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return found.withColumn("ok", F.col("ol_cnt") == F.col("n_lines"))


@query("check_7", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_linestatus = 'O') <> (o_orderstatus = 'O')""")
def check_7(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.where((F.col("l_linestatus") == "O") != (F.col("o_orderstatus") == "O")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("stock_level", "SELECT count(DISTINCT l_partkey) AS low_stock FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey >= 100 AND l_orderkey < 3000 AND p_size < 15")
def stock_level(spark, d):
    recent = table(spark, d, "lineitem").where("l_orderkey >= 100 and l_orderkey < 3000").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, d, "part").where("p_size < 15").join(recent, "p_partkey", "left_semi").agg(F.count("*").alias("low_stock"))
