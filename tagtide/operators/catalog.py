"""Series dimension, tag postings and tag predicates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.plans.spec import check_condition


def series_dimension(points: DataFrame) -> DataFrame:
    """One row per series. Tags belong to the id, so any row's tags do; the least is taken for a fixed result."""
    keyed = points.where(F.col("series_id").isNotNull())
    entries = F.array_sort(F.map_entries("tags"))
    return keyed.groupBy("metric", "series_id").agg(F.map_from_entries(F.min(entries)).alias("tags"))


def tag_postings(series: DataFrame) -> DataFrame:
    """(metric, tag_key, tag_value, series_id), one row per pair."""
    return series.select("metric", F.explode("tags").alias("tag_key", "tag_value"), "series_id").distinct()


def tag_condition(filters: Mapping[str, object] | None, tags: str | Column = "tags") -> Column:
    """Conjunction over tags: equality, ``('!=', v)`` which keeps series without the tag, and ``('=~', p)``,
    an unanchored Java regular expression that needs the tag."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    parts = []
    for key, wanted in (filters or {}).items():
        check_condition(key, wanted)
        held = tags[F.lit(key)]
        if isinstance(wanted, str):
            parts.append(held == wanted)
        elif wanted[0] == "!=":
            parts.append(~held.eqNullSafe(F.lit(wanted[1])))
        else:
            parts.append(held.rlike(wanted[1]))
    return reduce(and_, parts) if parts else F.lit(True)


def match_series(series: DataFrame, metric: str, filters: Mapping[str, object] | None = None) -> DataFrame:
    return series.where((F.col("metric") == metric) & F.coalesce(tag_condition(filters), F.lit(False)))


def match_by_postings(
    series: DataFrame, postings: DataFrame, metric: str, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """The same answer as match_series, read from postings: one aggregation counts the fulfilled positive
    conditions per series, one anti join removes the excluded ones."""
    filters = dict(filters or {})
    for key, wanted in filters.items():
        check_condition(key, wanted)
    own = postings.where(F.col("metric") == metric)
    found = series.where(F.col("metric") == metric)

    def hit(key, wanted) -> Column:
        pair = F.col("tag_key") == key
        if isinstance(wanted, str):
            return pair & (F.col("tag_value") == wanted)
        return pair & (F.col("tag_value") == wanted[1] if wanted[0] == "!=" else F.col("tag_value").rlike(wanted[1]))

    positive = {k: w for k, w in filters.items() if isinstance(w, str) or w[0] == "=~"}
    negative = {k: w for k, w in filters.items() if k not in positive}
    if positive:
        either = reduce(lambda a, b: a | b, [hit(k, w) for k, w in positive.items()])
        full = (
            own.where(either)
            .groupBy("series_id")
            .agg(F.count_distinct("tag_key").alias("held"))
            .where(F.col("held") == len(positive))
        )
        found = found.join(full, "series_id", "left_semi")
    if negative:
        either = reduce(lambda a, b: a | b, [hit(k, w) for k, w in negative.items()])
        found = found.join(own.where(either), "series_id", "left_anti")
    return found.select("metric", "series_id", "tags")


def index_stats(series: DataFrame) -> DataFrame:
    """One row: number of series, distinct (key, value) postings and distinct keys."""
    pairs = series.select(F.explode_outer("tags").alias("tag_key", "tag_value"), "series_id")
    return pairs.agg(
        F.count_distinct("series_id").alias("n_series"),
        F.count_distinct("tag_key", "tag_value").alias("n_postings"),
        F.count_distinct("tag_key").alias("n_tag_keys"),
    )


def series_of_metric(series: DataFrame, metric: str) -> DataFrame:
    return series.where(F.col("metric") == metric).select("series_id")


def tags_of_series(series: DataFrame, series_id: str) -> DataFrame:
    """The tags of one series; no row for an unknown id."""
    return series.where(F.col("series_id") == series_id).select("series_id", "tags")
