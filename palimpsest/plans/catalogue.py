"""All queries of the engine's own operators with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import cdc, checks, reads, scalars, versioned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (reads, checks, versioned, cdc, scalars):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
