"""Large values: inline or out of line, fetched by join, cleaned up by anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A value is stored inline up to INLINE bytes with its HEADER.
INLINE, HEADER = 2048, 4


def storage(value: Column) -> Column:
    """`inline` or `lob` by stored size; null for a null value."""
    return F.when(value.isNotNull(), F.when(F.octet_length(value) + HEADER <= INLINE, "inline").otherwise("lob"))


def split(df: DataFrame, rid: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with locators, LOB table): long values move to the LOB table, under their row's id."""
    far = storage(F.col(column)) == "lob"
    rows = df.withColumn("locator", F.when(far, F.col(rid))).withColumn(column, F.when(~far, F.col(column)))
    return rows, df.where(far).select(F.col(rid).alias("locator"), F.col(column).alias("value"))


def fetch(rows: DataFrame, lobs: DataFrame, column: str) -> DataFrame:
    """Rows with their long values put back."""
    joined = rows.join(lobs, "locator", "left")
    return joined.withColumn(column, F.coalesce("value", column)).drop("value", "locator")


def orphans(lobs: DataFrame, rows: DataFrame) -> DataFrame:
    """Long values that no row refers to any more."""
    return lobs.join(rows.where("locator is not null").select("locator").distinct(), "locator", "left_anti")
