"""Keyed scans: conjunctions of (column, operator, value) as filters that reach the Parquet reader."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v, ">=": lambda c, v: c >= v, ">": lambda c, v: c > v,
}


@dataclass(frozen=True)
class Key:
    """One condition: a comparison, `is null`, `is not null`, `in`, or a comparison with `any` of a list."""

    column: str
    op: str
    value: Any = None

    def condition(self) -> Column:
        """A null column or argument is never a match; nulls in a list are passed over, and an empty list matches nothing."""
        c = F.col(self.column)
        if self.op == "is null":
            return c.isNull()
        if self.op == "is not null":
            return c.isNotNull()
        if self.op in COMPARE:
            return F.lit(False) if self.value is None else COMPARE[self.op](c, F.lit(self.value))
        values = sorted({v for v in self.value or () if v is not None})
        if not values:
            return F.lit(False)
        if self.op in ("in", "= any"):
            return c.isin(values)
        op = self.op.removesuffix(" any")
        return COMPARE[op](c, F.lit(values[-1] if op in ("<", "<=") else values[0]))


def scan(df: DataFrame, keys: list[Key] = (), columns: list[str] | None = None) -> DataFrame:
    """Rows that meet all the keys, with the columns asked for."""
    found = df.where(reduce(lambda a, b: a & b, (k.condition() for k in keys))) if keys else df
    return found.select(*columns) if columns else found


def simplify(keys: list[Key]) -> tuple[list[Key], bool]:
    """The fewest comparison keys that mean the same, and whether they contradict each other.

    For each column an equality absorbs the others or contradicts them; else the tightest bound from
    each side stays. `is null` contradicts every comparison, which implies `is not null`.
    """
    out: list[Key] = []
    for column in dict.fromkeys(k.column for k in keys):
        own = [k for k in keys if k.column == column]
        compared = [k for k in own if k.op in COMPARE]
        if any(k.value is None for k in compared) or any(k.op == "is null" for k in own) and len({k.op for k in own}) > 1:
            return keys, True
        equal = [k for k in compared if k.op == "="]
        if equal:
            v = equal[0].value
            holds = {"<": lambda x: v < x, "<=": lambda x: v <= x, "=": lambda x: v == x, ">=": lambda x: v >= x, ">": lambda x: v > x}
            if not all(holds[k.op](k.value) for k in compared):
                return keys, True
            out.append(equal[0])
        else:
            below = [k for k in compared if k.op in ("<", "<=")]
            above = [k for k in compared if k.op in (">", ">=")]
            out += [min(below, key=lambda k: (k.value, k.op == "<="))] if below else []
            out += [max(above, key=lambda k: (k.value, k.op == ">"))] if above else []
        out += [k for k in own if k.op not in COMPARE and not (k.op == "is not null" and compared)]
    return list(dict.fromkeys(out)), False


def block_of(rid: Column, rows_per_block: int) -> Column:
    return F.floor(rid / rows_per_block).cast("long")


def sample_blocks(df: DataFrame, rid: str, rows_per_block: int, blocks: list[int]) -> DataFrame:
    """The rows of the blocks that the caller picked."""
    return df.where(block_of(F.col(rid), rows_per_block).isin(blocks))


def fetch(df: DataFrame, rids: DataFrame, rid: str) -> DataFrame:
    """The rows with the given ids; repeated ids fetch a row once."""
    return df.join(rids.select(rid).distinct(), rid, "left_semi")
