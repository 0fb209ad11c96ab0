"""Chunks of 3600 points per series in arrival order: numbering, statistics, pruning and coded sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.columns import ratio
from tagtide.operators.blocks import numbered

#: Points per chunk and bytes of one uncompressed point.
CHUNK_POINTS = 3600
RAW_POINT_BYTES = 16


def chunked(points: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Adds chunk_id; a chunk holds 3600 consecutive points of a series by seq."""
    return (
        numbered(points, ["series_id"], "seq", width)
        .withColumn("chunk_id", F.floor((F.col("rn") - 1) / CHUNK_POINTS).cast("int"))
        .drop("rn")
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row per chunk; sealed once full."""
    return (
        chunks.groupBy("series_id", "chunk_id")
        .agg(
            F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
        )
        .withColumn("sealed", F.col("n_points") == CHUNK_POINTS)
        .withColumn("raw_bytes", F.col("n_points") * RAW_POINT_BYTES)
    )


def prune(stats: DataFrame, t_start: int, t_end: int) -> DataFrame:
    """Chunks that can hold a point of the inclusive range."""
    return stats.where((F.col("max_ts") >= int(t_start)) & (F.col("min_ts") <= int(t_end)))


def chunk_counts(stats: DataFrame) -> DataFrame:
    return stats.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("sealed").alias("sealed"),
        F.count_if(~F.col("sealed")).alias("open"),
    )


def _code_bits(dod: Column) -> Column:
    return (
        F.when(dod == 0, 1)
        .when(dod.between(-63, 64), 9)
        .when(dod.between(-255, 256), 12)
        .when(dod.between(-2047, 2048), 16)
        .when(dod.between(-32767, 32768), 21)
        .otherwise(38)
    )


def ts_sizes(chunks: DataFrame) -> DataFrame:
    """Bytes of the timestamp stream of every chunk, without encoding it: the code length of each second
    difference of the chunk's times in ascending order. The window is bounded by the chunk."""
    w = Window.partitionBy("series_id", "chunk_id").orderBy("ts", "seq")
    gap = F.col("ts") - F.lag("ts").over(w)
    steps = chunks.select("series_id", "chunk_id", "seq", "ts", gap.alias("gap"))
    before = F.lag("gap").over(w)
    bits = (
        F.when(F.col("gap").isNull(), 64)
        .when(F.col("before").isNull(), 65)
        .otherwise(_code_bits(F.col("gap") - F.col("before")))
    )
    return (
        steps.withColumn("before", before)
        .groupBy("series_id", "chunk_id")
        .agg(F.count(F.lit(1)).alias("n_points"), F.sum(bits).cast("bigint").alias("bits"))
        .withColumn("ts_bytes", F.ceil(F.col("bits") / 8).cast("bigint"))
    )


def storage_stats(encoded: DataFrame) -> DataFrame:
    """Totals over encoded chunks: points, raw and coded bytes and the ratio raw / coded."""
    return encoded.agg(
        F.sum("n_points").alias("n_points"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("compressed_bytes").alias("compressed_bytes"),
        F.count_distinct("series_id").alias("n_series"),
    ).withColumn("ratio", ratio(F.col("raw_bytes"), F.col("compressed_bytes")))
