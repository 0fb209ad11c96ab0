"""Aggregation of points per series: whole range, automatic merge and tumbling buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.functions.aggregates import named
from tagtide.functions.columns import ORDER_SPAN, bucket_label, bucket_start, order_key

#: Labels of where a bucket's value comes from.
RAW, ONE_BUCKET, MERGED, CROSS, MISSING = "raw", "pre_agg:1", "pre_agg:n", "cross_merged", "missing"


def event_order(interval: int | None = None) -> Column:
    """Order of points by (ts, seq); within buckets of a known width as a key of fixed width."""
    if interval is None or interval >= ORDER_SPAN:
        return F.struct("ts", "seq")
    return order_key(F.pmod(F.col("ts"), F.lit(int(interval))), F.col("seq"))


def range_aggregate(points: DataFrame, agg: str) -> DataFrame:
    """One row per series at the time of its first point. Series without points give no row."""
    return points.groupBy("series_id").agg(
        F.min("ts").alias("bucket_ts"), named(agg).point(F.col("value"), event_order()).alias("value")
    )


def auto_merge(per_series: DataFrame, agg: str, metric: str, several: Column) -> DataFrame:
    """All series into one row with the same function, ordered by first time and id. ``several`` tells whether more
    than one series matched; if not, the one row there is stays as it is."""
    order = F.struct("bucket_ts", "series_id")
    return (
        per_series.groupBy()
        .agg(
            F.min("bucket_ts").alias("bucket_ts"),
            named(agg).across(F.col("value"), order).alias("merged"),
            F.max("value").alias("single"),
            F.min("series_id").alias("id"),
        )
        .where(F.col("bucket_ts").isNotNull())
        .select(
            F.when(several, f"{metric}::__aggregate__").otherwise(F.col("id")).alias("series_id"),
            "bucket_ts",
            F.when(several, F.col("merged")).otherwise(F.col("single")).alias("value"),
        )
    )


def downsample(
    points: DataFrame,
    agg: str,
    interval: int,
    t_start: int | None = None,
    labels: bool = False,
    keys: tuple[str, ...] = ("series_id",),
) -> DataFrame:
    """One row per series and non-empty bucket, read from points; ``labels`` adds a source column that says so."""
    made = points.groupBy(*keys, bucket_start(F.col("ts"), interval).alias("bucket")).agg(
        named(agg).point(F.col("value"), event_order(interval)).alias("value")
    )
    return made.select(
        *keys,
        bucket_label(F.col("bucket"), t_start).alias("bucket_ts"),
        "value",
        *([F.lit(RAW).alias("source")] if labels else []),
    )
