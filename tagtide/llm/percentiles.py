"""Exact percentiles per group by a full distributed sort.

State that merges over any parts, by day, file or partition, is the table of distinct readings (k1, k2, ts, value): parts
may hold copies of the same reading, the union keeps one. State that is smaller, one row per group and distinct value,
is the table of value counts (k1, k2, value, n); it merges by adding n, without error where no reading lies in two
parts, as when parts are days of ts. To answer, all counts are range-partitioned and sorted by (group, value); each task cuts its rows into runs of one group and counts them; counts per (group,
partition) give each partition's offset within the group; target positions fall into single runs, where the order
statistics are read. Percentile q of n values is the linear interpolation at position (n - 1) * q; the error is 0.

A group may hold any share of the rows: it spans as many sort partitions as its distinct values need, and a value
repeated any number of times is one row, combined before every shuffle. Nothing is collected or broadcast by hand.
The sorted runs are written to the shared folder once: offsets and order statistics must come from one and the same sort.

Defined cases: null and NaN values and rows without group key are left out; copies (same series, time, value)
count once; a group of one value has that value as every percentile; infinite values sort at the ends; a
percentile between two infinities, or one and a number, is the lower neighbour; an empty table gives no rows;
other columns are ignored. Series without zone, with a blank one or not
registered belong to no zone group; they have percentiles of their own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.term_frequency import folded
from tagtide.operators.blocks import written
from tagtide.operators.readings import KEY, metric_of, of_kind, series_key, series_names

RUN_ROWS = 1024
RUNS = "pid int, k1 bigint, k2 bigint, local_start bigint, total bigint, vals array<double>, ends array<bigint>"


def series_readings(points: DataFrame, catalog: DataFrame, kind: str = "gauge") -> DataFrame:
    """(k1, k2, ts, value), the distinct readings of a kind: state of a part of the points that merges exactly."""
    return of_kind(points, catalog, kind).select(*series_key(F.col("series_id")), "ts", "value").distinct()


def merge_readings(*tables: DataFrame) -> DataFrame:
    """Readings of all tables together; one that lies in several counts once."""
    return reduce(DataFrame.unionByName, tables).distinct()


def value_counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("n"))


def series_counts(points: DataFrame, catalog: DataFrame, kind: str = "gauge") -> DataFrame:
    """Value counts per series of the readings of a kind."""
    return value_counts(series_readings(points, catalog, kind))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Counts of parts that have no reading in common, such as days of ts; for others merge their readings."""
    return reduce(DataFrame.unionByName, tables).groupBy(*KEY, "value").agg(F.sum("n").alias("n"))


def group_key(metric: Column, zone: Column) -> list[Column]:
    """Key of a (metric, zone) group, in the same form as a series key."""
    return [F.xxhash64(metric, zone).alias("g1"), F.xxhash64(F.lit(2), zone, metric).alias("g2")]


def series_groups(series: DataFrame) -> DataFrame:
    """(k1, k2, series_id, metric, zone, g1, g2) of every registered series; zone is null where there is none."""
    zone = folded(F.col("tags")["zone"])
    rows = series.where(F.col("series_id").isNotNull()).select(
        "series_id", metric_of(F.col("series_id")).alias("metric"), F.when(zone != "", zone).alias("zone")
    )
    one = rows.groupBy("series_id", "metric").agg(F.min("zone").alias("zone"))
    return one.select(*series_key(F.col("series_id")), "series_id", "metric", "zone", *group_key(F.col("metric"), F.col("zone")))


def group_counts(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts per series added up to counts per group, keyed by the group."""
    member = groups.where(F.col("zone").isNotNull()).select(*KEY, "g1", "g2")
    return (
        counts.join(member, KEY)
        .groupBy(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "value")
        .agg(F.sum("n").alias("n"))
    )


def _runs(batches):
    """Sorted rows to runs: at most RUN_ROWS rows of one group. local_start counts the values of the group that
    this partition holds before the run."""
    pid = TaskContext.get().partitionId()
    held = (None, None)
    seen = 0
    for batch in batches:
        if not len(batch):
            continue
        k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
        vals, n = batch["value"].to_numpy(), batch["n"].to_numpy()
        fresh = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
        edges = np.concatenate([[0], fresh, [len(batch)]])
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if (k1[a], k2[a]) != held:
                held, seen = (k1[a], k2[a]), 0
            for s in range(a, b, RUN_ROWS):
                e = min(b, s + RUN_ROWS)
                ends = np.cumsum(n[s:e])
                out.append((pid, k1[s], k2[s], seen, int(ends[-1]), vals[s:e], ends))
                seen += int(ends[-1])
        yield pd.DataFrame(out, columns=["pid", "k1", "k2", "local_start", "total", "vals", "ends"])


def sorted_runs(counts: DataFrame) -> DataFrame:
    """The sorted counts, written once; both passes below read the same rows."""
    ordered = counts.select(*KEY, "value", "n").repartitionByRange(*KEY, "value").sortWithinPartitions(*KEY, "value")
    return written(ordered.mapInPandas(_runs, RUNS))


def _pick(batches):
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            for t in row.targets:
                local = t["rank"] - row.start
                out.append((row.k1, row.k2, row.n, t["q"], t["side"], t["share"], row.vals[np.searchsorted(row.ends, local, "right")]))
        if out:
            yield pd.DataFrame(out, columns=["k1", "k2", "n", "q", "side", "share", "value"])


def percentiles_of(runs: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """(k1, k2, n, q, value), exact, for every group of the sorted runs."""
    if not qs or min(qs) < 0 or max(qs) > 1:
        raise ValueError("percentiles lie between 0 and 1")
    per = runs.groupBy(*KEY, "pid").agg(F.sum("total").alias("held"))
    one = Window.partitionBy(*KEY)
    offsets = per.select(
        *KEY, "pid", F.sum("held").over(one).alias("n"),
        F.coalesce(F.sum("held").over(one.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    placed = runs.join(offsets, [*KEY, "pid"]).withColumn("start", F.col("before") + F.col("local_start"))

    def target(q: float, side: int) -> Column:
        at = (F.col("n") - 1) * F.lit(float(q))
        low = F.floor(at).cast("bigint")
        rank = F.least(low + side, F.col("n") - 1)
        return F.struct(rank.alias("rank"), F.lit(float(q)).alias("q"), F.lit(side).alias("side"), (at - low).alias("share"))

    wanted = F.array(*[target(q, side) for q in qs for side in (0, 1)])
    inside = F.filter(wanted, lambda t: (t["rank"] >= F.col("start")) & (t["rank"] < F.col("start") + F.col("total")))
    hit = placed.withColumn("targets", inside).where(F.size("targets") > 0)
    picked = hit.select(*KEY, "n", "start", "vals", "ends", "targets").mapInPandas(
        _pick, "k1 bigint, k2 bigint, n bigint, q double, side int, share double, value double"
    )
    low = F.max(F.when(F.col("side") == 0, F.col("value"))).alias("low")
    high = F.max(F.when(F.col("side") == 1, F.col("value"))).alias("high")
    ends = picked.groupBy(*KEY, "n", "q").agg(low, high, F.max("share").alias("share"))
    between = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    finite = (F.abs("low") < float("inf")) & (F.abs("high") < float("inf"))
    return ends.select(*KEY, "n", "q", F.when(finite, between).otherwise(F.col("low")).alias("value"))


def gauge_percentiles(
    points: DataFrame, catalog: DataFrame, series: DataFrame, qs: tuple[float, ...] = (0.25, 0.5, 0.75)
) -> tuple[DataFrame, DataFrame]:
    """Percentiles of every gauge series and of every (metric, zone) group in one table, and the groups."""
    groups = series_groups(series)
    counts = series_counts(points, catalog)
    runs = sorted_runs(counts.unionByName(group_counts(counts, groups)))
    return percentiles_of(runs, qs), groups


def outlying_series(points: DataFrame, catalog: DataFrame, series: DataFrame, fence: float = 4.0) -> DataFrame:
    """Series whose median lies more than ``fence`` quartile ranges outside the quartiles of their group."""
    made, groups = gauge_percentiles(points, catalog, series)
    pick = lambda q, name: F.max(F.when(F.col("q") == q, F.col("value"))).alias(name)
    flat = made.groupBy(*KEY).agg(pick(0.25, "q1"), pick(0.5, "median"), pick(0.75, "q3"))
    members = groups.where(F.col("zone").isNotNull()).join(flat.select(*KEY, "median"), KEY)
    bounds = flat.select(F.col("k1").alias("g1"), F.col("k2").alias("g2"), "q1", "q3")
    wide = fence * (F.col("q3") - F.col("q1"))
    outside = (F.col("median") > F.col("q3") + wide) | (F.col("median") < F.col("q1") - wide)
    return members.join(bounds, ["g1", "g2"]).where(outside).select("series_id")


def named_percentiles(
    points: DataFrame, catalog: DataFrame, series: DataFrame, qs: tuple[float, ...]
) -> DataFrame:
    """(scope, name, n, q, value): scope ``series`` with its id, scope ``group`` with ``metric|zone``."""
    made, groups = gauge_percentiles(points, catalog, series, qs)
    own = series_names(points).select(*KEY, F.lit("series").alias("scope"), F.col("series_id").alias("name"))
    zones = (
        groups.where(F.col("zone").isNotNull())
        .select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), F.lit("group").alias("scope"),
                F.concat_ws("|", "metric", "zone").alias("name"))
        .distinct()
    )
    return made.join(own.unionByName(zones), KEY).select("scope", "name", "n", "q", "value")
