"""Aggregation across series: one value per series and bucket first, then one per bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.functions.aggregates import named
from tagtide.operators.downsample import CROSS, MISSING


def cross_series(per_series: DataFrame, cross_agg: str, metric: str) -> DataFrame:
    """Series without the bucket are skipped. first and last follow the series id."""
    return (
        per_series.groupBy("bucket_ts")
        .agg(named(cross_agg).across(F.col("value"), F.col("series_id")).alias("value"))
        .select(
            F.lit(f"{metric}::__cross_agg__").alias("series_id"), "bucket_ts", "value", F.lit(CROSS).alias("source")
        )
    )


def group_by_tag(per_series: DataFrame, tag_value: Column, tag: str, cross_agg: str, metric: str) -> DataFrame:
    """One result series per value of a tag; series without the tag are dropped."""
    return (
        per_series.withColumn("tag_value", tag_value)
        .where(F.col("tag_value").isNotNull())
        .groupBy("tag_value", "bucket_ts")
        .agg(named(cross_agg).across(F.col("value"), F.col("series_id")).alias("value"))
        .select(
            F.concat(F.lit(f"{metric}::{tag}="), "tag_value").alias("series_id"),
            "bucket_ts",
            "value",
            F.lit(CROSS).alias("source"),
        )
    )


def present_sources(per_series: DataFrame) -> DataFrame:
    """(bucket_ts, series_id, source) of what is there, one row per series and non-empty bucket."""
    return per_series.select("bucket_ts", "series_id", "source")


def missing_counts(per_series: DataFrame, matched: DataFrame) -> DataFrame:
    """(bucket_ts, n_present, n_missing): how many matched series lack the bucket. One number per bucket."""
    total = matched.select(F.count_distinct("series_id")).scalar()
    return (
        per_series.groupBy("bucket_ts")
        .agg(F.count_distinct("series_id").alias("n_present"))
        .withColumn("n_missing", total - F.col("n_present"))
    )


def cross_sources(per_series: DataFrame, matched: DataFrame, limit: int = 10_000) -> DataFrame:
    """Per bucket a map of every matched series to its source, ``missing`` where it has no point. Such a map has as
    many entries as series match, so the query fails when there are more than ``limit`` of them; ``present_sources``
    and ``missing_counts`` hold for any number."""
    few = matched.select("series_id").distinct().limit(limit + 1)
    ids = few.select(F.array_sort(F.collect_list("series_id"))).scalar()
    present = per_series.groupBy("bucket_ts").agg(
        F.array_sort(F.collect_list(F.struct("series_id", "source"))).alias("held"), ids.alias("ids")
    )
    told = F.raise_error(F.lit(f"more than {limit} series match; use present_sources and missing_counts"))
    checked = F.when(F.size("ids") > limit, told.cast("array<string>")).otherwise(F.col("ids"))
    absent = F.transform(
        F.array_except(checked, F.transform("held", lambda h: h["series_id"])),
        lambda s: F.struct(s.alias("series_id"), F.lit(MISSING).alias("source")),
    )
    return present.select("bucket_ts", F.map_from_entries(F.array_sort(F.concat("held", absent))).alias("series_sources"))


def pooled(points: DataFrame, cross_agg: str, interval: int, metric: str, t_start: int | None = None) -> DataFrame:
    """Point-weighted alternative: all points of all series in a bucket form one group."""
    from tagtide.operators.downsample import downsample

    made = downsample(points.withColumn("series_id", F.lit(f"{metric}::__pooled__")), cross_agg, interval, t_start)
    return made.withColumn("source", F.lit(CROSS))
