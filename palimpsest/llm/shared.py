"""Helpers that several corpus operators use: work folders, skew-safe joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many narrow rows (a few tens of bytes each) may be broadcast.
BROADCAST_ROWS = 200_000
#: A node with more than this part of all links, and at least so many, is joined apart from the others: there are fewer than HOT_PART such.
HOT_PART, HOT_LINKS = 1000, 200
#: So few links are no burden to one task, whatever their nodes.
FEW_LINKS = 10_000


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which executors and driver share.

    Where the setting is unset, a session on one machine gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives freed memory back to the system at its end, as workers live on through other tasks."""

    def through(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return through


class Workspace:
    """Written intermediate tables of one operator call: they cut lineage and survive lost executors.

    An operator drops those that its answer doesn't read. The others may go once the answer has been
    written: each call's are in a folder of its own, spark.checkpoint.dir/palimpsest-*, and drop() without a name removes it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = work_folder(spark)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        """Removes that table, or the whole folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most that many rows; reads no more than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a written table of unique keys: broadcast if its counted rows fit the bound, else shuffled.

    Beyond the bound a hot key of the left side is divided by adaptive skew-join splitting, as the
    right side has one row a key.
    """
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    names = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in names:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _hot_join(left: DataFrame, right: DataFrame, key: str, links: int) -> DataFrame:
    """left with right's columns (a row a node) where left's key is right's node, else null.

    Keys of very many rows are few; their rows meet right's by broadcast and aren't gathered in a task.
    """
    if links <= FEW_LINKS:
        return left.join(right.withColumnRenamed("node", key), key, "left")
    count = left.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("n_")).where(F.col("n_") > max(HOT_LINKS, links // HOT_PART))
    hot = right.join(F.broadcast(count.select("node")), "node", "right").withColumn("hot_", F.lit(True))
    marked = left.join(F.broadcast(hot).withColumnRenamed("node", key), key, "left")
    rest = marked.where("hot_ is null").select(*left.columns).join(right.withColumnRenamed("node", key), key, "left")
    return marked.where("hot_").drop("hot_").unionByName(rest)


def connected_components(ws: Workspace, links: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node reachable.

    Alternating large-star and small-star rounds over links from greater to lesser nodes: grouped minima and
    joins with them. Each round is written, and no group is ever gathered in a task. Nodes must be orderable, not null.
    """
    edges = ws.table(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, n = None, edges.count()
    for turn in range(1, max_rounds + 1):
        # large star: a node's greater neighbours move on to its least one
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        large = _hot_join(edges, least, "b", n).select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = ws.table(large, f"{name}-{turn}-large")
        # small star: a node and its lesser neighbours go to the least of these
        down = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.max("b").alias("most"))
        split = _hot_join(large, down.where("m < most").select("node", "m"), "a", n).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = ws.table(split.unionByName(down.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), f"{name}-{turn}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        ws.drop(f"{name}-{turn}-large")
        ws.drop(f"{name}-{turn - 1}")
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
