"""Results as objects for small answers, and per-series query statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.functions.columns import ratio
from tagtide.operators.downsample import CROSS, MERGED, ONE_BUCKET, RAW
from tagtide.operators.rollup import stored_for
from tagtide.plans.spec import coarsest_within


def query_stats(result: DataFrame, interval: int | None = None, stored: tuple[str, ...] | None = None) -> DataFrame:
    """Per result series: buckets by source, the granularity that answers the interval (among the ``stored`` ones if
    given) and the share of buckets answered from whole rollup rows, which is 0 where no rollup was read."""
    fitting = coarsest_within(interval)[:1] if interval and coarsest_within(interval) else None
    if stored is not None and interval:
        name = stored_for(interval, stored)
        fitting = (name,) if name else None
    stored = F.count_if(F.col("source").isin(ONE_BUCKET, MERGED))
    return result.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("total_buckets"),
        F.count_if(F.col("source") == RAW).alias("raw_buckets"),
        F.count_if(F.col("source") == ONE_BUCKET).alias("single_buckets"),
        F.count_if(F.col("source") == MERGED).alias("merged_buckets"),
        F.count_if(F.col("source") == CROSS).alias("cross_buckets"),
        F.lit(fitting[0] if fitting else None).cast("string").alias("source_granularity"),
        ratio(stored, F.count(F.lit(1))).alias("pre_agg_hit_ratio"),
    )


@dataclass
class ResultSeries:
    series_id: str
    tags: dict = field(default_factory=dict)
    points: list = field(default_factory=list)
    sources: list = field(default_factory=list)

    def __repr__(self):
        shown = ", ".join(f"({t}, {v:.2f}, {s})" for (t, v), s in list(zip(self.points, self.sources))[:5])
        more = len(self.points) - 5
        return f"ResultSeries({self.series_id}: {shown}{f', +{more} more' if more > 0 else ''})"


def nested(result: DataFrame, matched: DataFrame | None = None, limit: int = 100_000) -> list[ResultSeries]:
    """Series ascending, points ascending. With ``matched`` series, those without points appear empty and tags
    are filled. For presentation: raises beyond ``limit`` rows or series instead of loading an unbounded result."""
    rows = result.orderBy("series_id", "bucket_ts").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; keep the DataFrame")
    found: dict[str, ResultSeries] = {}
    if matched is not None:
        series = matched.orderBy("series_id").limit(limit + 1).collect()
        if len(series) > limit:
            raise ValueError(f"more than {limit} series; keep the DataFrame")
        for r in series:
            found[r["series_id"]] = ResultSeries(r["series_id"], dict(r["tags"] or {}))
    for r in rows:
        s = found.setdefault(r["series_id"], ResultSeries(r["series_id"]))
        s.points.append((r["bucket_ts"], r["value"]))
        s.sources.append(r["source"])
    return [found[k] for k in sorted(found)]
