"""tagtide: tagged metric series as Spark DataFrames, planned by Catalyst."""

from tagtide.functions.aggregates import AGGREGATES, register
from tagtide.plans.planner import query
from tagtide.plans.spec import GRANULARITIES, QuerySpec

__all__ = ["AGGREGATES", "GRANULARITIES", "QuerySpec", "query", "register"]
