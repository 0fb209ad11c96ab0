"""From a QuerySpec to one declarative DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.operators.catalog import match_series, tag_condition
from tagtide.operators.crossseries import cross_series, cross_sources, group_by_tag
from tagtide.operators.downsample import RAW, auto_merge, downsample, range_aggregate
from tagtide.operators.rollup import stitch, stored_granularities
from tagtide.operators.scan import range_scan
from tagtide.plans.spec import QuerySpec


def query(
    points: DataFrame,
    spec: QuerySpec,
    series: DataFrame | None = None,
    rollup: DataFrame | None = None,
    complete_through: int | None = None,
    diagnostics: bool = False,
    stored: tuple[str, ...] | None = None,
) -> DataFrame:
    """Rows of (series_id, bucket_ts, value, source), with ``seq`` added for raw points. ``diagnostics`` adds
    ``series_sources`` to cross results (of a bounded number of series, see ``cross_sources``) and, with a rollup,
    ``read`` to results per series: what each bucket was read from. ``stored`` names the granularities of the rollup;
    without it a query over its granularity column finds them for the metric.

    Without a series dimension the tag condition runs on the points' own tags in the scan stage. With one,
    the dimension is filtered and semi-joined; its size decides between broadcast and shuffle, by Spark's
    own threshold. A rollup answers whole buckets; without one every bucket is read from points and labelled raw. No
    matching series gives no rows. An aggregate without interval and without dimension learns from all points, whatever
    their time, whether several series match; with a dimension it reads the range only."""
    if series is None:
        if rollup is not None or diagnostics:
            raise ValueError("rollups and diagnostics need the series dimension")
        own = points.where(F.col("metric") == spec.metric).where(tag_condition(spec.tag_filters))
        matched = None
    else:
        matched = match_series(series, spec.metric, spec.tag_filters)
        ids = matched.select("series_id")
        own = points.where(F.col("metric") == spec.metric).join(ids, "series_id", "left_semi")
    scan = range_scan(own, spec.t_start, spec.t_end)

    if spec.interval is None:
        if spec.agg is None:
            return scan.select("series_id", F.col("ts").alias("bucket_ts"), "value", "seq", F.lit(RAW).alias("source"))
        per = range_aggregate(scan, spec.agg)
        ids = matched if matched is not None else own
        several = ids.select(F.min("series_id") != F.max("series_id")).scalar()
        return auto_merge(per, spec.agg, spec.metric, several).withColumn("source", F.lit(RAW))

    keys = ("series_id",)
    if spec.group_by is not None and matched is None:
        keys = ("series_id", "tag_value")
        scan = scan.withColumn("tag_value", F.col("tags")[spec.group_by])
    if rollup is not None:
        held = rollup.where(F.col("metric") == spec.metric)
        stored = stored_granularities(held) if stored is None else stored
        kept = held.join(ids, "series_id", "left_semi")
        reads = diagnostics and spec.cross_agg is None
        per = stitch(
            own, kept, spec.point_agg, spec.interval, spec.t_start, spec.t_end, complete_through, stored, reads
        )
    else:
        per = downsample(scan, spec.point_agg, spec.interval, spec.t_start, labels=True, keys=keys)
    if spec.cross_agg is None:
        return per
    if spec.group_by is not None:
        if matched is not None:
            per = per.join(matched.select("series_id", F.col("tags")[spec.group_by].alias("tag_value")), "series_id")
        return group_by_tag(per, F.col("tag_value"), spec.group_by, spec.cross_agg, spec.metric)
    out = cross_series(per, spec.cross_agg, spec.metric)
    return out.join(cross_sources(per, matched), "bucket_ts") if diagnostics else out
