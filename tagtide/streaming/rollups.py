"""Points and rollups kept by Structured Streaming.

``start_ingest`` takes up every point, however late: each micro-batch appends its points to a store and the partial
states of their buckets to a rollup, both under its batch id, so a batch replayed after a failure replaces its own rows.
Partial states of one bucket merge exactly, by sums, extremes and order keys, so a late point is one more partial state
and no bucket is ever read again; ``merged`` reads the rollup, ``compact_merged`` rewrites it. Beside them it keeps up to
which time the points of a metric have arrived, for stitching, and how many came later than that.

``start_rollup`` holds the buckets in state instead: ``update`` mode emits the whole aggregate of a touched bucket again,
readers take the newest version. Points later than its watermark are not in it; ``repair`` recomputes their buckets from
stored points.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.functions.columns import DAY_S, bucket_start
from tagtide.operators.rollup import STATE, finished, merged_states, point_states, rollup_points
from tagtide.plans.spec import GRANULARITIES

KEY = ["granularity", "metric", "series_id", "bucket_ts"]


def streaming_rollup(points: DataFrame, granularity: str, lateness: str = "1 day") -> DataFrame:
    """Partial aggregates per (series, window) over a stream of points with a BIGINT ``ts``."""
    width = GRANULARITIES[granularity]
    timed = (
        points.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
        .withColumn("event_time", F.timestamp_seconds("ts"))
        .withWatermark("event_time", lateness)
    )
    made = timed.groupBy("metric", "series_id", F.window("event_time", f"{width} seconds")).agg(
        *point_states(F.col("ts"), F.col("seq"))
    )
    return finished(made.withColumn("bucket_ts", F.unix_seconds("window.start")), granularity)


def start_rollup(points: DataFrame, granularity: str, path: str, checkpoint: str, lateness: str = "1 day", once=True):
    """Start the query. A batch that is replayed after a failure overwrites its own partition."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/granularity_={granularity}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    made = streaming_rollup(points, granularity, lateness).writeStream.outputMode("update").foreachBatch(keep)
    made = made.option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if once else made).start()


def newest(versions: DataFrame) -> DataFrame:
    """The newest row per key of a versioned rollup table."""
    kept = F.max_by(F.struct("interval_s", *STATE), "batch_id").alias("v")
    return versions.groupBy(*KEY).agg(kept).select(*KEY, "v.*")


def repair(rollup: DataFrame, points: DataFrame, late: DataFrame, granularity: str) -> DataFrame:
    """The rollup with every bucket touched by late points recomputed from all points. In a store partitioned by day the
    days of these buckets prune the scan."""
    bucket = bucket_start(F.col("ts"), GRANULARITIES[granularity]).alias("bucket_ts")
    touched = late.select("metric", "series_id", bucket).distinct()
    own, keys = points.withColumn("bucket_ts", bucket), ["metric", "series_id", "bucket_ts"]
    if "day" in points.columns:
        day = F.floor(F.col("bucket_ts") / DAY_S).cast("bigint")
        again = own.join(touched.withColumn("day", day), [*keys, "day"], "left_semi")
    else:
        again = own.join(touched, keys, "left_semi")
    kept = rollup.where(F.col("granularity") == granularity).join(touched, keys, "left_anti")
    return kept.unionByName(rollup_points(again.drop("bucket_ts"), granularity))


def compact(versions: DataFrame, path: str) -> None:
    """Write the newest rows to a fresh table."""
    newest(versions).write.mode("overwrite").partitionBy("granularity").parquet(path)


def start_ingest(
    points: DataFrame, path: str, checkpoint: str, granularity: str = "1m", lateness_s: int = 3600, once: bool = True
):
    """Start taking up a stream of points under ``path``: points/, rollup/ and progress/."""
    spark = points.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        own = batch.where(F.col("ts").isNotNull() & F.col("value").isNotNull()).persist()
        try:
            day = F.floor(F.col("ts") / DAY_S).cast("bigint")
            stored = own.withColumn("day", day).hint("rebalance", F.col("metric"), F.col("day"))
            stored.sortWithinPartitions("metric", "day", "series_id", "ts").write.mode("overwrite").partitionBy(
                "metric", "day"
            ).parquet(f"{path}/points/batch_id={batch_id}")
            rollup_points(own, granularity).write.mode("overwrite").parquet(f"{path}/rollup/batch_id={batch_id}")
            before = arrived(spark, path, batch_id).select("metric", F.col("complete_through").alias("was"))
            told = own.join(before, "metric", "left").groupBy("metric").agg(
                (F.max("ts") - lateness_s).alias("complete_through"), F.count(F.lit(1)).alias("n_points"),
                F.count_if(F.col("ts") <= F.col("was")).alias("n_late"),
            )
            told.write.mode("overwrite").parquet(f"{path}/progress/batch_id={batch_id}")
        finally:
            own.unpersist()

    made = points.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if once else made).start()


PROGRESS = "metric string, complete_through bigint, n_points bigint, n_late bigint, batch_id bigint"


def arrived(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """(metric, complete_through, n_points, n_late) of the batches taken up so far: one row per metric."""
    try:
        told = spark.read.schema(PROGRESS).parquet(f"{path}/progress")
    except AnalysisException:
        told = spark.createDataFrame([], PROGRESS)
    if before_batch is not None:
        told = told.where(F.col("batch_id") < before_batch)
    return told.groupBy("metric").agg(
        F.max("complete_through").alias("complete_through"), F.sum("n_points").alias("n_points"), F.sum("n_late").alias("n_late")
    )


def ingested_points(spark: SparkSession, path: str) -> DataFrame:
    """The points taken up, with their day; range scans prune metrics and days."""
    return spark.read.parquet(f"{path}/points").drop("batch_id")


def merged(partials: DataFrame) -> DataFrame:
    """One row per bucket from the partial states that batches left."""
    held = [r[0] for r in partials.select("granularity").distinct().collect()]
    if len(held) > 1:
        raise ValueError(f"partial states of one granularity are merged at a time, not of {sorted(held)}")
    return merged_states(partials, held[0]) if held else partials.drop("batch_id")


def ingested_rollup(spark: SparkSession, path: str) -> DataFrame:
    return merged(spark.read.parquet(f"{path}/rollup"))


def compact_merged(spark: SparkSession, path: str, target: str) -> None:
    """Write the merged rollup to a fresh table."""
    ingested_rollup(spark, path).write.mode("overwrite").partitionBy("granularity").parquet(target)
