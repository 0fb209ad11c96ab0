"""Ordered per-key computations that survive a key holding a large part of all rows.

A window over one key runs in one task. Here every key is cut into blocks, windows run within (key, block),
and what crosses block borders travels in one summary row per block.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder where all executors can read and write: in spark.checkpoint.dir as the cluster sets it, else in
    the checkpoint folder given to the context. Only a local master, as in tests, may do without one; elsewhere a
    folder of one machine would lose rows silently, so this raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = given.get() if given.isDefined() else None
    if not where:
        where = _local_folder(spark.sparkContext.master)
    return f"{where.rstrip('/')}/tagtide-{uuid.uuid4().hex}"


def _local_folder(master: str) -> str:
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/tagtide-checkpoints"


_WRITTEN: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. The folder is removed by ``release``, or else when
    the JVM ends."""
    spark = df.sparkSession
    where = shared_folder(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(where)
    _WRITTEN.append(where)
    return spark.read.schema(df.schema).parquet(where)


def release(spark: SparkSession) -> int:
    """Remove the folders written so far, once the results that read them have been used. Returns how many."""
    for where in _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    n = len(_WRITTEN)
    _WRITTEN.clear()
    return n


def numbered(df: DataFrame, keys: list[str], order: str, width: int, name: str = "rn") -> DataFrame:
    """1, 2, ... per key in the order of a unique BIGINT column: numbers within blocks of ``width`` of that
    column plus the counts of the blocks before. One summary row per (key, block) is windowed per key. Rows with a
    null key or order belong to no key and are left out."""
    df = df.where(reduce(and_, [F.col(c).isNotNull() for c in (*keys, order)]))
    block = F.floor(F.col(order) / F.lit(width)).cast("bigint")
    cut = df.withColumn("block_", block)
    sizes = cut.groupBy(*keys, "block_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(
        F.sum("n_").over(Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select(*keys, "block_", before.alias("before_"))
    inner = F.row_number().over(Window.partitionBy(*keys, "block_").orderBy(order))
    return (
        cut.withColumn("in_", inner)
        .join(offsets, [*keys, "block_"])
        .withColumn(name, F.col("in_") + F.col("before_"))
        .drop("block_", "in_", "before_")
    )
