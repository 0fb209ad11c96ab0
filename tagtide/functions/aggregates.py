"""The named aggregates and their three forms.

``point``  over points: value and an event-time order ``(ts, seq)``
``merge``  over rollup rows: exact combination of stored partial states; ``first_key`` and ``last_key`` order them
``across`` over one value per series: order decides first and last

Every form is a built-in Spark aggregate with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    name: str
    point: Callable[[Column, Column], Column]
    across: Callable[[Column, Column], Column]
    merge: Callable[[], Column] | None = None


AGGREGATES: dict[str, Aggregate] = {}


def register(name: str, point, across=None, merge=None) -> Aggregate:
    """Add an aggregate. Without ``merge`` it is never answered from rollups."""
    made = Aggregate(name, point, across or point, merge)
    AGGREGATES[name] = made
    return made


def named(name: str) -> Aggregate:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}; known: {sorted(AGGREGATES)}")
    return AGGREGATES[name]


register("sum", lambda v, o: F.sum(v), merge=lambda: F.sum("sum"))
register("avg", lambda v, o: F.avg(v), merge=lambda: F.sum("sum") / F.sum("count"))
register("min", lambda v, o: F.min(v), merge=lambda: F.min("min"))
register("max", lambda v, o: F.max(v), merge=lambda: F.max("max"))
register("count", lambda v, o: F.count(v).cast("double"), merge=lambda: F.sum("count").cast("double"))
register("first", lambda v, o: F.min_by(v, o), merge=lambda: F.min_by("first_val", "first_key"))
register("last", lambda v, o: F.max_by(v, o), merge=lambda: F.max_by("last_val", "last_key"))
