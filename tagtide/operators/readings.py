"""Readings: points cleaned of nulls, NaN and copies, addressed by a compact series key.

A reading is a row with series_id, ts and value neither null nor NaN; rows that agree in the three are one.
Series ids are long strings. Shuffles carry two 64-bit hashes of the id instead (``k1``, ``k2``, 128 bits: for
a billion series the chance of any collision is below 1e-20), and ids are joined back to results or to
block summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["k1", "k2"]
NO_INTERVAL = 60


def series_key(series_id: Column) -> list[Column]:
    return [F.xxhash64(series_id).alias("k1"), F.xxhash64(F.lit(1), series_id).alias("k2")]


def metric_of(series_id: Column) -> Column:
    return F.substring_index(series_id, "{", 1)


def valid(points: DataFrame) -> DataFrame:
    """Rows that can be readings. Copies are still there."""
    return points.select("series_id", "ts", "value", *(["seq"] if "seq" in points.columns else [])).where(
        F.col("series_id").isNotNull()
        & F.col("ts").isNotNull()
        & F.col("value").isNotNull()
        & ~F.isnan("value")
    )


def of_kind(points: DataFrame, catalog: DataFrame, kind: str) -> DataFrame:
    """Valid rows of the series whose metric has the kind, with interval_s and limits. The catalogue has one
    row per metric (a repeated metric keeps its least row); Spark broadcasts it while it is below its threshold."""
    facts = (
        catalog.where(F.col("kind") == kind)
        .groupBy(F.col("metric").alias("metric_"))
        .agg(F.min(F.struct("interval_s", "low_limit", "high_limit")).alias("f"))
        .select("metric_", "f.*")
    )
    return valid(points).withColumn("metric_", metric_of(F.col("series_id"))).join(facts, "metric_").drop("metric_")


def series_names(points: DataFrame) -> DataFrame:
    """(k1, k2, series_id) of every series written, from the id column alone."""
    ids = points.where(F.col("series_id").isNotNull()).select("series_id").distinct()
    return ids.select(*series_key(F.col("series_id")), "series_id")
