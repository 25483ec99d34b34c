"""Aggregates over scans, and reconciliation of two aggregates by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.scan import Key, scan


def count_rows(df: DataFrame, keys: list[Key]) -> DataFrame:
    return scan(df, keys).agg(F.count("*").alias("n"))


def sum_or_zero(df: DataFrame, keys: list[Key], column: str, alias: str = "total") -> DataFrame:
    """The sum as double; 0.0, not null, over no rows. Summed as decimal, so it doesn't depend on the order of tasks."""
    return scan(df, keys).agg(F.coalesce(F.sum(F.col(column).cast("decimal(28,6)")).cast("double"), F.lit(0.0)).alias(alias))


def extreme_row(df: DataFrame, keys: list[Key], column: str, columns: list[str], largest: bool) -> DataFrame:
    """The whole row that has the least or greatest value, ties by all the columns; no row over no rows."""
    pick = F.max if largest else F.min
    return scan(df, [*keys, Key(column, "is not null")]).agg(pick(F.struct(column, *[c for c in columns if c != column])).alias("r")).where("r is not null").select(*[f"r.{c}" for c in columns])


def outcome_rates(df: DataFrame, kind: Column, committed: Column) -> DataFrame:
    """Committed and aborted counts of each kind, and the aborted share in percent."""
    flags = df.select(kind.alias("kind"), committed.alias("ok"))
    both = flags.groupBy("kind").agg(F.count_if("ok").alias("committed"), F.count_if(~F.col("ok")).alias("aborted"))
    return both.withColumn("aborted_pct", F.round(100.0 * F.col("aborted") / (F.col("committed") + F.col("aborted")), 4))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str, tolerance: float = 0.0) -> DataFrame:
    """Both sides by key with ok: whether they agree within the tolerance; a missing side counts as 0."""
    both = left.select(*keys, left_value).join(right.select(*keys, right_value), keys, "full_outer")
    a, b = F.coalesce(F.col(left_value), F.lit(0)), F.coalesce(F.col(right_value), F.lit(0))
    return both.select(*keys, a.alias(left_value), b.alias(right_value), (F.abs(a - b) <= tolerance).alias("ok"))
