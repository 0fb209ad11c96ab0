"""Materialised partial aggregates: build, read, merge, stitch with raw points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.functions.aggregates import named
from tagtide.functions.columns import DAY_S, ORDER_SPAN, bucket_label, bucket_start, order_key, order_offset, order_seq
from tagtide.operators.downsample import MERGED, ONE_BUCKET, RAW, downsample
from tagtide.operators.scan import range_scan
from tagtide.plans.spec import GRANULARITIES, coarsest_within

STATE = ["count", "sum", "min", "max", "first_ts", "first_seq", "first_val", "last_ts", "last_seq", "last_val"]


def point_states(ts: Column, seq: Column) -> list[Column]:
    """Aggregates of the points of one bucket of a day or less, all with buffers of fixed width. The keys order points
    within their day, so they stay as they are while buckets are made coarser."""
    key = order_key(F.pmod(ts, F.lit(DAY_S)), seq)
    return [
        F.count("value").alias("count"),
        F.sum("value").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min(key).alias("first_key"),
        F.min_by("value", key).alias("first_val"),
        F.max(key).alias("last_key"),
        F.max_by("value", key).alias("last_val"),
    ]


def keyed(rollup: DataFrame, width: int = DAY_S) -> DataFrame:
    """Rollup rows with first_key and last_key, their order within buckets of the width."""
    key = lambda end: order_key(F.pmod(F.col(f"{end}_ts"), F.lit(int(width))), F.col(f"{end}_seq"))
    return rollup.withColumns({"first_key": key("first"), "last_key": key("last")})


def finished(states: DataFrame, granularity: str) -> DataFrame:
    """Rollup rows from states whose keys order points within their day."""
    day = bucket_start(F.col("bucket_ts"), DAY_S)
    ends = [
        made
        for end in ("first", "last")
        for made in (
            (day + order_offset(F.col(f"{end}_key"))).alias(f"{end}_ts"),
            order_seq(F.col(f"{end}_key")).alias(f"{end}_seq"),
            F.col(f"{end}_val"),
        )
    ]
    return states.select(
        F.lit(granularity).alias("granularity"), F.lit(GRANULARITIES[granularity]).cast("bigint").alias("interval_s"),
        "metric", "series_id", "bucket_ts", "count", "sum", "min", "max", *ends,
    )


def _states(points: DataFrame, granularity: str) -> DataFrame:
    bucket = bucket_start(F.col("ts"), GRANULARITIES[granularity])
    return (
        points.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
        .groupBy("metric", "series_id", bucket.alias("bucket_ts"))
        .agg(*point_states(F.col("ts"), F.col("seq")))
    )


def _coarser(states: DataFrame, granularity: str, within: tuple[str, ...] = ()) -> DataFrame:
    """States of coarser buckets; widths divide each other, so this is exact. Columns named in ``within`` are constant
    in a coarse bucket and are kept."""
    bucket = bucket_start(F.col("bucket_ts"), GRANULARITIES[granularity]).alias("bucket_ts")
    return states.groupBy("metric", "series_id", *within, bucket).agg(
        F.sum("count").alias("count"),
        F.sum("sum").alias("sum"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.min_by("first_val", "first_key").alias("first_val"),
        F.min("first_key").alias("first_key"),
        F.max_by("last_val", "last_key").alias("last_val"),
        F.max("last_key").alias("last_key"),
    )


def rollup_points(points: DataFrame, granularity: str) -> DataFrame:
    """Rollup rows of one granularity straight from points."""
    return finished(_states(points, granularity), granularity)


def coarsen(rollup: DataFrame, granularity: str) -> DataFrame:
    """Rollup rows of a coarser granularity from stored finer ones."""
    return finished(_coarser(keyed(rollup), granularity), granularity)


def merged_states(partials: DataFrame, granularity: str) -> DataFrame:
    """One row per bucket from any number of rows of it, each of other points."""
    return finished(_coarser(keyed(partials), granularity), granularity)


def build_rollup(points: DataFrame, granularities=tuple(GRANULARITIES)) -> DataFrame:
    """All asked granularities in one table, each from the next finer one; write it partitioned by ``granularity``.
    Points are aggregated and shuffled once, for the finest. Its rows are then placed by (series, day), at most one
    row per finest bucket of a day, and every coarser level is made where they lie."""
    names = [g for g in GRANULARITIES if g in set(granularities)]
    if not names:
        raise ValueError("no granularity asked")
    level = _states(points, names[0])
    if len(names) == 1:
        return finished(level, names[0])
    level = level.withColumn("day_", bucket_start(F.col("bucket_ts"), DAY_S)).repartition("series_id", "day_")
    out = finished(level, names[0])
    for name in names[1:]:
        level = _coarser(level, name, ("day_",))
        out = out.unionByName(finished(level, name))
    return out


def contained(rollup: DataFrame, granularity: str, t_start: int | None, t_end: int | None) -> DataFrame:
    """Rows of buckets that lie wholly in the half-open range ``[t_start, t_end)``."""
    own = rollup.where(F.col("granularity") == granularity)
    if t_start is not None:
        own = own.where(F.col("bucket_ts") >= int(t_start))
    if t_end is not None:
        own = own.where(F.col("bucket_ts") <= int(t_end) - GRANULARITIES[granularity])
    return own


def read_rollup(rollup: DataFrame, granularity: str, agg: str, t_start=None, t_end=None) -> DataFrame:
    """One finished value per stored bucket."""
    named(agg)
    final = {
        "sum": F.col("sum"), "avg": F.col("sum") / F.col("count"), "min": F.col("min"), "max": F.col("max"),
        "count": F.col("count").cast("double"), "first": F.col("first_val"), "last": F.col("last_val"),
    }
    if agg not in final:
        raise ValueError(f"aggregate {agg!r} is not kept in rollups")
    return contained(rollup, granularity, t_start, t_end).select("series_id", "bucket_ts", final[agg].alias("value"))


def mark_complete(rollup: DataFrame, complete_through: int) -> DataFrame:
    """Which stored buckets can still change, given the time up to which all points have arrived."""
    done = F.col("bucket_ts") + F.col("interval_s") - 1 <= int(complete_through)
    return rollup.withColumn("state", F.when(done, "complete").otherwise("partial"))


def rollup_stats(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("granularity").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("count").alias("n_points"))


def stored_granularities(rollup: DataFrame) -> tuple[str, ...]:
    """Names of the granularities a rollup holds, finest first. Runs a query; on a store partitioned by granularity it
    reads no column."""
    held = {r[0] for r in rollup.select("granularity").distinct().collect()}
    return tuple(g for g in GRANULARITIES if g in held)


def stored_for(interval: int, stored: tuple[str, ...]) -> str | None:
    """The coarsest stored granularity that divides the interval; None where an interval is answered from points
    whatever is stored. Raises where no stored granularity divides an interval that rollups can answer."""
    best = coarsest_within(interval)
    if best is None or interval % best[1] or interval >= ORDER_SPAN:
        return None
    fitting = [g for g, w in GRANULARITIES.items() if g in stored and interval % w == 0]
    if not fitting:
        raise ValueError(f"the rollup holds {list(stored)}, none of which divides {interval} s; query without it")
    return fitting[-1]


def source_label(interval: int, width: int, t_start: int | None, t_end: int | None) -> Column:
    """Label of a bucket read from rollup rows of the width, ``parts`` of which are there: of one or of several rows
    where every one is there, else raw, the label a bucket with holes bears by rule although no point is read."""
    inside = F.lit(True)
    if t_start is not None:
        inside = inside & (F.col("bucket") >= int(t_start))
    if t_end is not None:
        inside = inside & (F.col("bucket") + (interval - 1) <= int(t_end))
    whole = inside & (F.col("parts") == interval // width)
    return F.when(whole, F.lit(ONE_BUCKET if interval == width else MERGED)).otherwise(F.lit(RAW))


def stitch(
    points: DataFrame,
    rollup: DataFrame,
    agg: str,
    interval: int,
    t_start: int | None = None,
    t_end: int | None = None,
    complete_through: int | None = None,
    stored: tuple[str, ...] | None = None,
    reads: bool = False,
) -> DataFrame:
    """Downsample from rollups where they hold whole buckets and from points at the clipped edges.

    ``stored`` names the granularities the rollup holds for the metric (looked up if not given): the coarsest that
    divides the interval answers; a rollup that holds none at all leaves everything to the points. Interior buckets
    never touch points: a missing rollup row means there are none. The raw scan is limited to the head and tail
    ranges, both of which reach the reader as range and day predicates. Buckets that end after ``complete_through``
    are taken from points as well. Values equal those of a raw downsample. ``reads`` adds a column ``read``, rollup
    or points, that tells what each bucket was read from."""
    if stored is None:
        stored = stored_granularities(rollup)
    name = stored_for(interval, tuple(stored)) if stored else None
    form = named(agg)
    read = lambda df, what: df.withColumn("read", F.lit(what)) if reads else df
    head = None if t_start is None else -(-int(t_start) // interval) * interval
    ends = [e for e in (t_end, complete_through) if e is not None]
    tail = (min(ends) + 1) // interval * interval if ends else None
    if name is None or form.merge is None or (head is not None and tail is not None and tail <= head):
        return read(downsample(range_scan(points, t_start, t_end), agg, interval, t_start, labels=True), "points")

    rows = rollup.where(F.col("granularity") == name)
    if head is not None:
        rows = rows.where(F.col("bucket_ts") >= head)
    if tail is not None:
        rows = rows.where(F.col("bucket_ts") < tail)
    made = (
        keyed(rows, interval)
        .groupBy("series_id", bucket_start(F.col("bucket_ts"), interval).alias("bucket"))
        .agg(form.merge().alias("value"), F.count(F.lit(1)).alias("parts"))
        .select(
            "series_id",
            bucket_label(F.col("bucket"), t_start).alias("bucket_ts"),
            "value",
            source_label(interval, GRANULARITIES[name], t_start, t_end).alias("source"),
        )
    )
    made = read(made, "rollup")
    edges = []
    if head is not None and head != t_start:
        edges.append((t_start, head - 1))
    if tail is not None and (t_end is None or tail <= t_end):
        edges.append((tail, t_end))
    for a, b in edges:
        part = downsample(range_scan(points, a, b), agg, interval, t_start if a == t_start else None, labels=True)
        made = made.unionByName(read(part, "points"))
    return made


__all__ = [
    "STATE", "build_rollup", "coarsen", "contained", "mark_complete", "read_rollup", "rollup_points", "rollup_stats",
    "stitch", "stored_granularities",
]
