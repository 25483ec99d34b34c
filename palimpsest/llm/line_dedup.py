"""Operator 1: dropping lines that too many pages of a site share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace, fresh, small_enough

#: A line is boilerplate if it stands on more than this share of its site's pages,
RATIO = 0.08
#: and on at least so many of them, so that sites of a few pages keep their lines.
MIN_PAGES = 5
#: Without a broadcast, each site's lines are copied so often, to divide a hot site's pages.
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """Hashes of a text's different lines that aren't blank."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.length(F.trim(x)) > 0), lambda x: F.xxhash64(x)))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                copies_once: bool = False) -> DataFrame:
    """(host, hash, n_pages, n_host): lines on more than ratio of the host's pages and on min_pages at least.

    Counts are summed before and after one shuffle of (host, hash), so a hot host or line costs no
    more than its distinct lines. Rows with a null host are in no site. With copies_once, a host's rows
    of equal text are one page; its (line, text) pairs are then shuffled by all their columns before.
    """
    pages = docs.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("host"), F.col(text_col).cast("string").alias("t"))
    counted, lines = pages, pages.select("host", F.explode(_hashes(F.col("t"))).alias("hash"))
    if copies_once:
        page = F.xxhash64("t").alias("page")
        counted, lines = pages.select("host", page).distinct(), pages.select("host", page, F.explode(_hashes(F.col("t"))).alias("hash")).distinct()
    hosts = counted.groupBy("host").agg(F.count("*").alias("n_host")).withColumnRenamed("host", "h")
    lines = lines.groupBy("host", "hash").agg(F.count("*").alias("n_pages"))
    frequent = lines.where(F.col("n_pages") >= min_pages)
    return frequent.join(hosts, F.col("host") == F.col("h")).where(F.col("n_pages") > ratio * F.col("n_host")).drop("h")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                     count_col: str | None = None, broadcast_rows: int = 200_000, copies_once: bool = False) -> DataFrame:
    """The rows of docs with their boilerplate lines taken out of text_col.

    Every row stays, so a text of boilerplate alone becomes empty. Blank lines stay. A null text or
    null host leaves the row as it is; repeated rows count as so many pages unless copies_once is
    set, which counts a host's equal texts once; an empty table gives an empty table; other columns pass through, whatever their names. count_col, if named, gets the number
    of dropped lines. Lines are held by 64-bit hash within their host.

    A host has at most (its mean lines a page / ratio) boilerplate lines, so they fit an array. The
    arrays are broadcast if all hosts' lines number at most broadcast_rows, else joined by host and salt.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    found = ws.table(boilerplate(docs, host_col, text_col, ratio, min_pages, copies_once).select("host", "hash"), "boilerplate")
    host, bad, salt, own = (fresh(docs, x) for x in ("_host", "_bad", "_salt", "_own"))
    arrays = found.groupBy(F.col("host").alias(host)).agg(F.collect_list("hash").alias(bad))
    if small_enough(found, broadcast_rows):
        joined = docs.join(F.broadcast(arrays), docs[host_col] == F.col(host), "left")
    else:
        arrays = arrays.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = salted.join(arrays.withColumnRenamed(salt, salt + "r"), (F.col(host_col) == F.col(host)) & (F.col(salt) == F.col(salt + "r")), "left").drop(salt, salt + "r")
    joined = joined.withColumn(own, F.when(F.col(bad).isNotNull(), F.array_intersect(_hashes(F.col(text_col)), F.col(bad))))
    kept = F.filter(_lines(F.col(text_col)), lambda x: ~F.array_contains(F.col(own), F.xxhash64(x)))
    hit = F.size(F.col(own)) > 0
    if count_col:
        joined = joined.withColumn(count_col, F.when(hit, (F.size(_lines(F.col(text_col))) - F.size(kept)).cast("long")).otherwise(F.lit(0).cast("long")))
    joined = joined.withColumn(text_col, F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text_col)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *([count_col] if count_col else []))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs, count_col="n_dropped").select("doc_id", "text", "n_dropped")


OP1_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS ls FROM documents),
lines AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(ls)) AS line FROM pages WHERE source IS NOT NULL) GROUP BY ALL),
hosts AS (SELECT source, count(*) AS m FROM documents GROUP BY ALL),
bad AS (SELECT source, list(line) AS bs FROM lines JOIN hosts USING (source) WHERE n >= {MIN_PAGES} AND n > {RATIO} * m GROUP BY source),
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS every,
               list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bs, []), x)) AS kept
        FROM pages LEFT JOIN bad USING (source))
SELECT doc_id, CASE WHEN len(kept) < len(every) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       CAST(coalesce(len(every) - len(kept), 0) AS BIGINT) AS n_dropped
FROM cut
"""
