"""Range scans that reach the Parquet reader as partition and pushed filters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.functions.columns import DAY_S


def in_range(t_start: int | None, t_end: int | None, ts: str = "ts") -> Column:
    """Both ends inclusive; an open end adds no predicate."""
    parts = []
    if t_start is not None:
        parts.append(F.col(ts) >= int(t_start))
    if t_end is not None:
        parts.append(F.col(ts) <= int(t_end))
    return reduce(and_, parts) if parts else F.lit(True)


def range_scan(points: DataFrame, t_start: int | None = None, t_end: int | None = None) -> DataFrame:
    """Points within the range. Stores partitioned by ``day`` also get a ``day`` predicate, which Catalyst
    does not derive from ``ts`` itself. Rows with a null time or value are no points."""
    kept = points.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).where(in_range(t_start, t_end))
    if "day" in points.columns:
        days = in_range(
            None if t_start is None else int(t_start) // DAY_S, None if t_end is None else int(t_end) // DAY_S, "day"
        )
        kept = kept.where(days)
    return kept
