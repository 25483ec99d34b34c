"""Index-shaped jobs: sorted projections, uniqueness, per-partition counts, online merge, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def build(df: DataFrame, keys: dict[str, Column], rid: str) -> DataFrame:
    """The index's rows: key expressions and row id, dealt by key range and sorted within, so files don't overlap."""
    rows = df.select(*(c.alias(n) for n, c in keys.items()), F.col(rid).alias("_rid"))
    order = [F.col(n).asc_nulls_last() for n in keys] + [F.col("_rid")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def duplicates(index: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with count, least and greatest row id; keys with a null are never duplicates."""
    return index.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"), F.min("_rid").alias("first_rid"), F.max("_rid").alias("last_rid")).where("n > 1")


def partition_counts(df: DataFrame, partition: str) -> DataFrame:
    """Rows of each partition and, under a null partition, of all; from one pass over partial counts."""
    each = df.groupBy(F.col(partition).cast("string").alias("part")).agg(F.count("*").alias("n"))
    return each.unionByName(each.agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("part"), "n"))


def merge_delta(base: DataFrame, delta: DataFrame, keys: list[str], sequence: str = "seq", op: str = "op") -> DataFrame:
    """The index after an online build: base entries with the last recorded change of each (keys, row id) applied."""
    entry = [*keys, "_rid"]
    last = delta.groupBy(*entry).agg(F.max_by(op, sequence).alias(op))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"d.{c}")) for c in entry]
    untouched = base.alias("b").join(last.alias("d"), same, "left_anti")
    return untouched.select(*entry).unionByName(last.where(F.col(op) == "INSERT").select(*entry))


def insert_verdicts(index: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new with satisfies_unique: false if its key stands in the index or earlier (by row id) among the new rows."""
    there = index.dropna(subset=keys).select(*keys).distinct().withColumn("_there", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_rid"))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return new.withColumn("_nth", nth).join(there, keys, "left").withColumn(
        "satisfies_unique", ~whole | (F.col("_there").isNull() & (F.col("_nth") == 1))).drop("_nth", "_there")


def remove(index: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The index without the given (keys, row id) entries."""
    return index.join(gone.select(*keys, "_rid"), [*keys, "_rid"], "left_anti")


def keep_live_partitions(index: DataFrame, partition: str, live: DataFrame) -> DataFrame:
    """Entries of partitions that still exist."""
    return index.join(live.select(partition).distinct(), partition, "left_semi")
