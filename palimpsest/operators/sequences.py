"""Sequences: values in closed form, so that blocks of them can be drawn in parallel."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sequence:
    increment: int = 1
    min_value: int = 1
    max_value: int = (1 << 63) - 1
    cycle: bool = False
    last_value: int = 1
    is_called: bool = False
    cache: int = 1

    def value(self, n: Column) -> Column:
        """The n-th value from now, n from 1; null beyond a bound without cycle.

        A cycle begins again at the least value going up and at the greatest going down.
        """
        step = n - (0 if self.is_called else 1)
        up = self.increment > 0
        room = (self.max_value - self.last_value if up else self.last_value - self.min_value) // abs(self.increment)
        straight = F.lit(self.last_value) + step * self.increment
        if not self.cycle:
            return F.when(step <= room, straight)
        length = (self.max_value - self.min_value) // abs(self.increment) + 1
        return F.when(step <= room, straight).otherwise(F.lit(self.min_value if up else self.max_value) + F.pmod(step - room - 1, F.lit(length)) * self.increment)

    def draw(self, spark: SparkSession, n: int) -> DataFrame:
        return spark.range(1, n + 1).select(F.col("id").alias("n"), self.value(F.col("id")).cast("long").alias("value"))

    def after(self, spark: SparkSession, n: int) -> Sequence:
        """The state after n draws, rounded up to whole cache blocks."""
        blocks = -(-n // self.cache) * self.cache
        last = self.draw(spark, blocks).where("value is not null").orderBy(F.desc("n")).first()
        return replace(self, last_value=last["value"], is_called=True) if last else self

    def row(self, spark: SparkSession) -> DataFrame:
        """The sequence's state as a row."""
        types = "last_value long, is_called boolean, increment long, min_value long, max_value long, cache long, cycle boolean"
        return spark.createDataFrame([(self.last_value, self.is_called, self.increment, self.min_value, self.max_value, self.cache, self.cycle)], types)

    def set(self, value: int, is_called: bool = True) -> Sequence:
        if not self.min_value <= value <= self.max_value:
            raise ValueError(f"{value} is out of bounds")
        return replace(self, last_value=value, is_called=is_called)

    def reset(self) -> Sequence:
        return replace(self, last_value=self.min_value, is_called=False)
