"""Total orders over whole tables: positions and running sums without a single-partition window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def key(column: str, desc: bool = False, nulls_first: bool = False) -> Column:
    """A sort key with its NULL placement spelled out; NaN sorts above all numbers, as Spark has it."""
    c = F.col(column)
    if desc:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def _shared(spark: SparkSession) -> str:
    """The folder that executors and driver share; one machine gets a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_folder(spark: SparkSession) -> str:
    return f"{_shared(spark).rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt by range and sorted within partitions, written, with _part and _at: the partition, and the place in it from 1."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id())
    return written(ranged).withColumn("_part", F.shiftright("_seq", 33).cast("int")).withColumn("_at", F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_seq")


def running(df: DataFrame, order: list[Column], value: Column | None = None, position: str = "position", before: str = "before") -> DataFrame:
    """df with its place in the order (from 1) and, if value is given, the sum of value over all rows before.

    Rows are dealt by range and sorted within partitions; one row a partition carries the counts that
    precede it, and only sums need a window over each partition's rows. The order must be total, else ties
    are placed arbitrarily.
    """
    v = (value if value is not None else F.lit(0)).cast("long")
    ranged = _ranged(df.withColumn("_v", v), order)
    sums = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    if value is not None:
        within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        ranged = ranged.withColumn("_sum", F.sum("_v").over(within) - F.col("_v"))
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn(position, (F.col("_at") + F.col("_n")).cast("long"))
    if value is not None:
        placed = placed.withColumn(before, F.col("_sum") + F.col("_s")).drop("_sum")
    return placed.drop("_part", "_v", "_n", "_s", "_at")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """df with each row's place within its group, from 1; a group of any size is spread over range partitions.

    Only groups that stand in several partitions need what precedes: two a partition at most, so they are broadcast.
    """
    ranged = _ranged(df, [F.col(c) for c in (*group, *order)])
    parts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    edges = ranged.groupBy("_part").agg(F.max("_at").alias("_last"))
    crossing = parts.join(F.broadcast(edges), "_part").where((F.col("_first") == 1) | (F.col("_first") + F.col("_n") - 1 == F.col("_last")))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = crossing.select(*group, "_part", F.sum("_n").over(earlier).alias("_before")).where("_before is not null")
    placed = ranged.join(parts.select(*group, "_part", "_first"), [*group, "_part"]).join(F.broadcast(crossing), [*group, "_part"], "left")
    return placed.withColumn(name, F.col("_at") - F.col("_first") + 1 + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_first", "_before")


def last_before(df: DataFrame, group: list[str], order: list[str], values: Column, name: str) -> DataFrame:
    """df with the last value that isn't null up to and with each row, in order within its group; null if there is none.

    Rows are dealt by range, so a group may have any size; each partition's last value, a row a partition, is carried on.
    """
    own = F.struct(*group).alias("_g")
    ranged = _ranged(df.withColumn("_value", values), [F.col(c) for c in (*group, *order)])
    held = F.when(F.col("_value").isNotNull(), F.struct(own, F.col("_value").alias("v")))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.where("_value is not null").groupBy("_part").agg(F.max_by(F.struct(own, F.col("_value").alias("v")), "_at").alias("_carried"))
    every = ranged.select("_part").distinct().join(parts, "_part", "left")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("_part", F.last("_carried", ignorenulls=True).over(earlier).alias("_carried"))
    found = ranged.withColumn("_last", F.last(held, ignorenulls=True).over(within)).join(F.broadcast(carried), "_part").withColumn("_last", F.coalesce("_last", "_carried"))
    return found.withColumn(name, F.when(F.col("_last._g").eqNullSafe(F.struct(*group)), F.col("_last.v"))).drop("_part", "_at", "_value", "_last", "_carried")


def first_row(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(1)
