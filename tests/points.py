"""Small points tables for tests."""

import math
import random

from pyspark.sql import functions as F

from tagtide.functions.columns import series_id

B = 1700006400
SCHEMA = "metric string, tags map<string,string>, ts bigint, value double, seq bigint"


def make(spark, rows):
    """rows: (tags, offset from B, value), in order of writing."""
    data = [("cpu", tags, B + int(t), float(v), i) for i, (tags, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumn("series_id", series_id(F.col("metric"), F.col("tags")))


def line(tags, n, c, k, step=10, start=0):
    return [(tags, start + i * step, c + i * k) for i in range(n)]


def wave(tags, n, base, amp, w, step=10, start=0):
    return [(tags, start + i * step, base + amp * math.sin(w * i)) for i in range(n)]


def gauss(tags, n=8640):
    rng = random.Random(99)
    return [(tags, i * 10, rng.gauss(50, 10)) for i in range(n)]


def slots(tags):
    rows = []
    for s in range(16):
        a = s * 900
        rows += [(tags, a + i, 10) for i in range(100)] if s % 2 == 0 else [(tags, a + i * 60, 100) for i in range(5)]
    return rows


def collect(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("bucket_ts").collect()]
