"""Named queries over the input tables and, where SQL can express them, the same in ANSI SQL for DuckDB.

Doubles are rounded to 6 places on both sides: sums of doubles depend on the order of addition.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.aggregates import AGGREGATES, register
from tagtide.functions.columns import epoch_seconds
from tagtide.operators import catalog, chunks, codec
from tagtide.operators.crossseries import cross_sources, missing_counts, pooled
from tagtide.operators.downsample import downsample
from tagtide.operators.result import query_stats
from tagtide.operators.rollup import build_rollup, mark_complete, read_rollup, rollup_stats
from tagtide.operators.scan import in_range, range_scan
from tagtide.plans.planner import query
from tagtide.plans.spec import GRANULARITIES, QuerySpec, coarsest_within
from tagtide.sources.tables import (
    event_points, line_points, order_points, read_points, stored_points, table, wide_to_points, write_points,
)

#: Ranges of the tests: the middle of the events, misaligned at both ends, and the orders of two years.
A, B = 1704071521, 1704931977
OA, OB = 820454400, 883612799
AGGS = ("sum", "avg", "min", "max", "count", "first", "last")
E_METRIC, O_METRIC, L_METRIC = "events.value", "orders.totalprice", "lineitem.quantity"

E_SQL = """SELECT 'events.value' AS metric, 'events.value{event_type=' || event_type || '}' AS series_id, event_type,
 epoch_us(ts) // 1000000 AS ts, CAST(value AS DOUBLE) AS value, event_id AS seq FROM events"""
O_SQL = """SELECT 'orders.totalprice' AS metric,
 'orders.totalprice{o_orderpriority=' || o_orderpriority || ',o_orderstatus=' || o_orderstatus || '}' AS series_id,
 o_orderpriority, o_orderstatus, epoch_us(o_orderdate) // 1000000 AS ts, o_totalprice AS value, o_orderkey AS seq
 FROM orders"""
L_SQL = """SELECT 'lineitem.quantity' AS metric,
 'lineitem.quantity{l_linestatus=' || l_linestatus || ',l_returnflag=' || l_returnflag || '}' AS series_id,
 l_linestatus, l_returnflag, epoch_us(l_shipdate) // 1000000 AS ts, l_quantity AS value,
 l_orderkey * 10 + l_linenumber AS seq FROM lineitem"""
SOURCES = {"e": E_SQL, "o": O_SQL, "l": L_SQL}
AGG_SQL = {
    "sum": "sum(value)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)",
    "count": "CAST(count(value) AS DOUBLE)", "first": "arg_min(value, (ts, seq))", "last": "arg_max(value, (ts, seq))",
}
ACROSS_SQL = AGG_SQL | {"first": "arg_min(value, series_id)", "last": "arg_max(value, series_id)"}


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def plain(df: DataFrame) -> DataFrame:
    return rounded(df).select("series_id", "bucket_ts", "value")


def with_p(source: str, body: str) -> str:
    return f"WITH p AS ({SOURCES[source]}) {body}"


def down_sql(source: str, agg: str, interval: int, a=None, b=None, where: str = "TRUE", extra: str = "") -> str:
    bounds = " AND ".join([where] + ([f"ts >= {a}"] if a is not None else []) + ([f"ts <= {b}"] if b is not None else []))
    label = f"(ts // {interval}) * {interval}"
    label = f"greatest({label}, {a})" if a is not None else label
    return with_p(
        source,
        f"SELECT series_id{extra}, {label} AS bucket_ts, {AGG_SQL[agg]} AS value FROM p WHERE {bounds} GROUP BY ALL",
    )


def round_sql(inner: str, cols: str = "series_id, bucket_ts") -> str:
    return f"SELECT {cols}, round(value, 6) AS value FROM ({inner})"


def source_sql(source: str, agg: str, interval: int, a: int, b: int) -> str:
    """Downsample with the label rule: wholly inside, divisible, all rollup rows present."""
    g = coarsest_within(interval)
    if g is None or interval % g[1]:
        label = "'raw'"
    else:
        kind = "pre_agg:1" if g[1] == interval else "pre_agg:n"
        label = (
            f"CASE WHEN bucket >= {a} AND bucket + {interval - 1} <= {b} AND parts = {interval // g[1]} "
            f"THEN '{kind}' ELSE 'raw' END"
        )
    parts = f"count(DISTINCT ts // {g[1]})" if g else "0"
    return with_p(
        source,
        f"""SELECT series_id, greatest(bucket, {a}) AS bucket_ts, round(value, 6) AS value, {label} AS source FROM (
 SELECT series_id, (ts // {interval}) * {interval} AS bucket, {AGG_SQL[agg]} AS value, {parts} AS parts
 FROM p WHERE ts BETWEEN {a} AND {b} GROUP BY ALL)""",
    )


QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


def spec_query(source, *args, **kwargs):
    return lambda spark, d, e=source: plain(query(e(spark, d), QuerySpec(*args, **kwargs)))


# ---- scans and tag predicates
add(
    "raw_range_scan",
    lambda s, d, e=event_points: rounded(query(e(s, d), QuerySpec(E_METRIC, t_start=A, t_end=B))).select(
        "series_id", "bucket_ts", "value", "seq"
    ),
    with_p("e", f"SELECT series_id, ts AS bucket_ts, round(value, 6) AS value, seq FROM p WHERE ts BETWEEN {A} AND {B}"),
)
TAGGED = {
    "tag_eq": ({"event_type": "click"}, "event_type = 'click'"),
    "tag_neq": ({"event_type": ("!=", "click")}, "event_type IS DISTINCT FROM 'click'"),
    "tag_regex": ({"event_type": ("=~", "^(cl|sign)")}, "regexp_matches(event_type, '^(cl|sign)')"),
}
for name, (filters, where) in TAGGED.items():
    add(
        name,
        spec_query(event_points, E_METRIC, filters, A, B, "avg", 3600),
        round_sql(down_sql("e", "avg", 3600, A, B, where)),
    )
add(
    "tag_and",
    spec_query(
        order_points, O_METRIC, {"o_orderstatus": ("!=", "F"), "o_orderpriority": ("=~", "^[1-3]")}, OA, OB, "sum", 86400
    ),
    round_sql(
        down_sql("o", "sum", 86400, OA, OB, "o_orderstatus <> 'F' AND regexp_matches(o_orderpriority, '^[1-3]')")
    ),
)
add(
    "tag_neq_missing_key",
    lambda s, d: (
        query(
            stored_points(s, d).withColumn("metric", F.lower(F.trim("metric"))),
            QuerySpec("cpu.busy", {"owner": ("!=", "platform")}, agg="count", interval=86400),
        )
        .where(F.col("series_id").isNotNull())
        .select("series_id", "bucket_ts", "value")
    ),
    """SELECT series_id, (ts // 86400) * 86400 AS bucket_ts, CAST(count(value) AS DOUBLE) AS value FROM points
 WHERE lower(trim(metric, ' ')) = 'cpu.busy' AND tags['owner'] IS DISTINCT FROM 'platform'
 AND ts IS NOT NULL AND value IS NOT NULL AND series_id IS NOT NULL GROUP BY ALL""",
)


# ---- catalogue
def registered(s, d) -> DataFrame:
    return table(s, d, "series").select("metric", "series_id", "tags")


add(
    "series_catalog",
    lambda s, d: catalog.series_dimension(order_points(s, d)).select("metric", "series_id"),
    with_p("o", "SELECT DISTINCT metric, series_id FROM p"),
)
add(
    "series_of_metric",
    lambda s, d: catalog.series_of_metric(registered(s, d), "cpu.busy"),
    "SELECT series_id FROM series WHERE metric = 'cpu.busy'",
)
add(
    "series_tags",
    lambda s, d: (
        catalog.series_dimension(order_points(s, d))
        .select("series_id", F.explode("tags").alias("tag_key", "tag_value"))
        .distinct()
    ),
    with_p(
        "o",
        "SELECT DISTINCT series_id, 'o_orderstatus' AS tag_key, o_orderstatus AS tag_value FROM p UNION ALL "
        "SELECT DISTINCT series_id, 'o_orderpriority', o_orderpriority FROM p",
    ),
)
MATCH = {"stage": "live", "zone": ("=~", "^(north|south)"), "owner": ("!=", "billing")}
add(
    "tag_index_match",
    lambda s, d: catalog.match_by_postings(registered(s, d), table(s, d, "tag_index"), "mem.used", MATCH).select(
        "series_id"
    ),
    """SELECT series_id FROM series WHERE metric = 'mem.used'
 AND series_id IN (SELECT series_id FROM tag_index WHERE metric = 'mem.used' AND tag_key = 'stage' AND tag_value = 'live')
 AND series_id IN (SELECT series_id FROM tag_index WHERE metric = 'mem.used' AND tag_key = 'zone'
  AND regexp_matches(tag_value, '^(north|south)'))
 AND series_id NOT IN (SELECT series_id FROM tag_index WHERE metric = 'mem.used' AND tag_key = 'owner'
  AND tag_value = 'billing' AND series_id IS NOT NULL)""",
)
add(
    "tag_match",
    lambda s, d: catalog.match_series(registered(s, d), "mem.used", MATCH).select("series_id"),
    """SELECT series_id FROM series WHERE metric = 'mem.used' AND tags['stage'] = 'live'
 AND regexp_matches(tags['zone'], '^(north|south)') AND tags['owner'] IS DISTINCT FROM 'billing'""",
)
add(
    "tag_index_stats",
    lambda s, d: catalog.index_stats(catalog.series_dimension(order_points(s, d))),
    with_p(
        "o",
        """SELECT count(DISTINCT series_id) AS n_series,
 count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) AS n_postings, 2 AS n_tag_keys FROM p""",
    ),
)

# ---- whole-range aggregates
for agg in AGGS:
    add(
        f"range_agg_{agg}",
        lambda s, d, agg=agg, e=event_points: plain(
            query(e(s, d), QuerySpec(E_METRIC, {"event_type": "view"}, A, B, agg))
        ),
        with_p(
            "e",
            f"SELECT series_id, min(ts) AS bucket_ts, round({AGG_SQL[agg]}, 6) AS value FROM p "
            f"WHERE ts BETWEEN {A} AND {B} AND event_type = 'view' GROUP BY series_id",
        ),
    )
MERGE_SQL = AGG_SQL | {"first": "arg_min(value, (ts, series_id))", "last": "arg_max(value, (ts, series_id))"}
for agg in AGGS:
    add(
        f"range_auto_merge_{agg}",
        spec_query(order_points, O_METRIC, {}, OA, OB, agg),
        with_p(
            "o",
            f"""SELECT 'orders.totalprice::__aggregate__' AS series_id, min(ts) AS bucket_ts,
 round({MERGE_SQL[agg]}, 6) AS value FROM (SELECT series_id, min(ts) AS ts, {AGG_SQL[agg]} AS value FROM p
 WHERE ts BETWEEN {OA} AND {OB} GROUP BY series_id) HAVING count(*) > 0""",
        ),
    )

# ---- downsampling
for agg in AGGS:
    add(
        f"downsample_{agg}",
        spec_query(event_points, E_METRIC, {}, 1704067200, 1706745599, agg, 21600),
        round_sql(down_sql("e", agg, 21600, 1704067200, 1706745599)),
    )
add("downsample_misaligned", spec_query(event_points, E_METRIC, {}, A, B, "avg", 1800), round_sql(down_sql("e", "avg", 1800, A, B)))
add("downsample_subminute", spec_query(event_points, E_METRIC, {}, A, B, "max", 10), round_sql(down_sql("e", "max", 10, A, B)))
add("downsample_nondivisible", spec_query(event_points, E_METRIC, {}, A, B, "avg", 5400), round_sql(down_sql("e", "avg", 5400, A, B)))
add("downsample_open_range", spec_query(order_points, O_METRIC, {}, None, None, "avg", 86400), round_sql(down_sql("o", "avg", 86400)))
add("downsample_points", lambda s, d: plain(downsample(
    range_scan(stored_points(s, d).where(F.col("series_id").isNotNull() & ~F.isnan("value"))), "avg", 3600)),
    """SELECT series_id, (ts // 3600) * 3600 AS bucket_ts, round(avg(value), 6) AS value FROM points
 WHERE series_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL""")  # fmt: skip

# ---- rollups
ROLL_COLS = "series_id, bucket_ts, count, round(sum, 6) AS sum, min, max, first_ts, first_val, last_ts, last_val"
for g, width in GRANULARITIES.items():
    add(
        f"rollup_{g}",
        lambda s, d, g=g, e=event_points: (
            build_rollup(e(s, d), [x for x, w in GRANULARITIES.items() if w <= GRANULARITIES[g]])
            .where(F.col("granularity") == g)
            .withColumn("sum", F.round("sum", 6))
            .select("series_id", "bucket_ts", "count", "sum", "min", "max", "first_ts", "first_val", "last_ts", "last_val")
        ),
        with_p(
            "e",
            f"""SELECT {ROLL_COLS} FROM (SELECT series_id, (ts // {width}) * {width} AS bucket_ts, count(*) AS count,
 sum(value) AS sum, min(value) AS min, max(value) AS max, min(ts) AS first_ts, arg_min(value, (ts, seq)) AS first_val,
 max(ts) AS last_ts, arg_max(value, (ts, seq)) AS last_val FROM p GROUP BY ALL)""",
        ),
    )
add(
    "rollup_contained",
    lambda s, d, e=event_points: plain(read_rollup(build_rollup(e(s, d), ["15m", "1h"]), "1h", "avg", A, B)),
    with_p(
        "e",
        f"""SELECT series_id, bucket_ts, round(value, 6) AS value FROM (SELECT series_id, (ts // 3600) * 3600 AS bucket_ts,
 avg(value) AS value FROM p GROUP BY ALL) WHERE bucket_ts >= {A} AND bucket_ts + 3600 <= {B}""",
    ),
)
add(
    "rollup_state",
    lambda s, d, e=event_points: (
        mark_complete(build_rollup(e(s, d), ["6h"]), B)
        .groupBy("state")
        .agg(F.count(F.lit(1)).alias("n_buckets"), F.sum("count").alias("n_points"))
    ),
    with_p(
        "e",
        f"""SELECT CASE WHEN bucket_ts + 21599 <= {B} THEN 'complete' ELSE 'partial' END AS state, count(*) AS n_buckets,
 CAST(sum(n) AS BIGINT) AS n_points FROM (SELECT series_id, (ts // 21600) * 21600 AS bucket_ts, count(*) AS n FROM p
 GROUP BY ALL) GROUP BY 1""",
    ),
)
add(
    "rollup_stats",
    lambda s, d, e=event_points: rollup_stats(build_rollup(e(s, d))),
    with_p(
        "e",
        " UNION ALL ".join(
            f"SELECT '{g}' AS granularity, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_points FROM "
            f"(SELECT series_id, ts // {w}, count(*) AS n FROM p GROUP BY ALL)"
            for g, w in GRANULARITIES.items()
        ),
    ),
)


def from_rollup(points: DataFrame, spec: QuerySpec, names: tuple[str, ...] = (), **kwargs) -> DataFrame:
    """The query over points and a rollup of them, of the coarsest fitting granularity if no names are given."""
    names = names or (coarsest_within(spec.interval)[0],)
    series = kwargs.pop("series", None) or catalog.series_dimension(points)
    return query(points, spec, series, build_rollup(points, names), stored=tuple(names), **kwargs)


def stitched(source, metric, agg, interval, a, b):
    def build(spark, d, e=source):
        out = from_rollup(e(spark, d), QuerySpec(metric, {}, a, b, agg, interval))
        return rounded(out).select("series_id", "bucket_ts", "value", "source")

    return build


add("rollup_stitch_avg", stitched(event_points, E_METRIC, "avg", 21600, A, B), source_sql("e", "avg", 21600, A, B))
add("rollup_stitch_last", stitched(event_points, E_METRIC, "last", 7200, A, B), source_sql("e", "last", 7200, A, B))
add("rollup_stitch_lines", stitched(line_points, L_METRIC, "sum", 172800, OA + 5, OB), source_sql("l", "sum", 172800, OA + 5, OB))
add(
    "bucket_sources",
    lambda s, d: rounded(from_rollup(line_points(s, d), QuerySpec(L_METRIC, {}, OA, OB, "max", 259200))).select(
        "series_id", "bucket_ts", "value", "source"
    ),
    source_sql("l", "max", 259200, OA, OB),
)


# ---- across series
def cross_sql(source: str, metric: str, agg: str, cross: str, interval: int, a, b) -> str:
    inner = down_sql(source, agg, interval, a, b)
    return (
        f"SELECT '{metric}::__cross_agg__' AS series_id, bucket_ts, round({ACROSS_SQL[cross]}, 6) AS value "
        f"FROM ({inner}) GROUP BY bucket_ts"
    )


for agg in AGGS:
    add(
        f"cross_{agg}",
        spec_query(event_points, E_METRIC, {}, 1704067200, 1706745599, "avg", 86400, agg),
        cross_sql("e", E_METRIC, "avg", agg, 86400, 1704067200, 1706745599),
    )
add(
    "cross_misaligned",
    spec_query(event_points, E_METRIC, {}, A, B, "sum", 3600, "avg"),
    cross_sql("e", E_METRIC, "sum", "avg", 3600, A, B),
)
add(
    "cross_pooled",
    lambda s, d, e=event_points: plain(pooled(range_scan(e(s, d), A, B), "avg", 86400, E_METRIC, A)),
    with_p(
        "e",
        f"""SELECT 'events.value::__pooled__' AS series_id, greatest((ts // 86400) * 86400, {A}) AS bucket_ts,
 round(avg(value), 6) AS value FROM p WHERE ts BETWEEN {A} AND {B} GROUP BY ALL""",
    ),
)


def order_sources(spark, d):
    points = order_points(spark, d)
    matched = catalog.match_series(catalog.series_dimension(points), O_METRIC)
    per = from_rollup(points, QuerySpec(O_METRIC, {}, OA, OB, "sum", 86400 * 7), series=matched)
    flat = cross_sources(per, matched).select("bucket_ts", F.explode("series_sources").alias("series_id", "source"))
    return flat.groupBy("bucket_ts").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("series_id", F.lit(":"), "source"))), ";").alias("sources")
    )


add(
    "cross_sources",
    order_sources,
    f"""WITH r AS ({source_sql("o", "sum", 604800, OA, OB)}),
 b AS (SELECT DISTINCT bucket_ts FROM r), m AS (SELECT DISTINCT series_id FROM ({O_SQL}))
 SELECT b.bucket_ts, string_agg(m.series_id || ':' || coalesce(r.source, 'missing'), ';'
  ORDER BY m.series_id || ':' || coalesce(r.source, 'missing')) AS sources
 FROM b CROSS JOIN m LEFT JOIN r ON r.bucket_ts = b.bucket_ts AND r.series_id = m.series_id GROUP BY b.bucket_ts""",
)
for agg in ("avg", "sum", "count"):
    add(
        f"group_by_tag_{agg}",
        spec_query(line_points, L_METRIC, {}, OA, OB, "avg", 86400, agg, "l_returnflag"),
        f"""SELECT 'lineitem.quantity::l_returnflag=' || l_returnflag AS series_id, bucket_ts,
 round({ACROSS_SQL[agg]}, 6) AS value FROM ({down_sql("l", "avg", 86400, OA, OB, extra=", l_returnflag")})
 GROUP BY l_returnflag, bucket_ts""",
    )
add(
    "group_by_absent_tag",
    spec_query(line_points, L_METRIC, {}, OA, OB, "avg", 86400, "avg", "rack"),
    "SELECT '' AS series_id, CAST(0 AS BIGINT) AS bucket_ts, CAST(0 AS DOUBLE) AS value WHERE FALSE",
)
add(
    "query_stats",
    lambda s, d, e=event_points: query_stats(
        from_rollup(e(s, d), QuerySpec(E_METRIC, {}, A, B, "avg", 21600)), 21600, ("6h",)
    ),
    f"""SELECT series_id, count(*) AS total_buckets, count(*) FILTER (source = 'raw') AS raw_buckets,
 count(*) FILTER (source = 'pre_agg:1') AS single_buckets, count(*) FILTER (source = 'pre_agg:n') AS merged_buckets,
 CAST(0 AS BIGINT) AS cross_buckets, '6h' AS source_granularity,
 count(*) FILTER (source LIKE 'pre%') / count(*) AS pre_agg_hit_ratio
 FROM ({source_sql("e", "avg", 21600, A, B)}) GROUP BY series_id""",
)

# ---- chunks and codec
CHUNK_SQL = f"SELECT *, CAST((row_number() OVER (PARTITION BY series_id ORDER BY seq) - 1) // 3600 AS INT) AS chunk_id FROM ({L_SQL})"
STATS_SQL = f"""SELECT series_id, chunk_id, count(*) AS n_points, min(ts) AS min_ts, max(ts) AS max_ts,
 count(*) = 3600 AS sealed, count(*) * 16 AS raw_bytes FROM ({CHUNK_SQL}) GROUP BY series_id, chunk_id"""
add("chunk_stats", lambda s, d: chunks.chunk_stats(chunks.chunked(line_points(s, d))), STATS_SQL)
add(
    "chunk_counts",
    lambda s, d: chunks.chunk_counts(chunks.chunk_stats(chunks.chunked(line_points(s, d)))),
    f"""SELECT series_id, count(*) AS total, count(*) FILTER (sealed) AS sealed, count(*) FILTER (NOT sealed) AS open
 FROM ({STATS_SQL}) GROUP BY series_id""",
)
add(
    "chunk_prune",
    lambda s, d, e=event_points: chunks.prune(chunks.chunk_stats(chunks.chunked(e(s, d))), A, B),
    f"""SELECT * FROM (SELECT series_id, chunk_id, count(*) AS n_points, min(ts) AS min_ts, max(ts) AS max_ts,
 count(*) = 3600 AS sealed, count(*) * 16 AS raw_bytes FROM (SELECT *, CAST((row_number() OVER (PARTITION BY series_id
 ORDER BY seq) - 1) // 3600 AS INT) AS chunk_id FROM ({E_SQL})) GROUP BY series_id, chunk_id)
 WHERE max_ts >= {A} AND min_ts <= {B}""",
)
add(
    "ts_compressed_size",
    lambda s, d: chunks.ts_sizes(chunks.chunked(line_points(s, d))),
    f"""WITH c AS (SELECT *, ts - lag(ts) OVER (PARTITION BY series_id, chunk_id ORDER BY ts, seq) AS gap FROM ({CHUNK_SQL})),
 d AS (SELECT *, lag(gap) OVER (PARTITION BY series_id, chunk_id ORDER BY ts, seq) AS before FROM c),
 s AS (SELECT *, gap - before AS dod FROM d)
 SELECT series_id, chunk_id, count(*) AS n_points, CAST(sum(CASE WHEN gap IS NULL THEN 64 WHEN before IS NULL THEN 65
 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12
 WHEN dod BETWEEN -2047 AND 2048 THEN 16 WHEN dod BETWEEN -32767 AND 32768 THEN 21 ELSE 38 END) AS BIGINT) AS bits,
 CAST(ceil(sum(CASE WHEN gap IS NULL THEN 64 WHEN before IS NULL THEN 65
 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12
 WHEN dod BETWEEN -2047 AND 2048 THEN 16 WHEN dod BETWEEN -32767 AND 32768 THEN 21 ELSE 38 END) / 8) AS BIGINT) AS ts_bytes
 FROM s GROUP BY series_id, chunk_id""",
)
add(
    "value_codec_roundtrip",
    lambda s, d, e=event_points: rounded(codec.unseal(codec.seal(chunks.chunked(e(s, d))))).select("series_id", "ts", "value"),
    with_p("e", "SELECT series_id, ts, round(value, 6) AS value FROM p"),
)
add("storage_stats", lambda s, d, e=event_points: chunks.storage_stats(codec.seal(chunks.chunked(e(s, d)))))


def late_points(spark, d, e=event_points):
    """Rollup rows after repairing the buckets of late points equal those of all points."""
    from tagtide.streaming.rollups import repair

    points = e(spark, d)
    late = points.where(F.col("seq") % 7 == 3)
    early = build_rollup(points.where(F.col("seq") % 7 != 3), ["1h"])
    return repair(early, points, late, "1h").withColumn("sum", F.round("sum", 6)).select(
        "series_id", "bucket_ts", "count", "sum", "min", "max", "first_ts", "first_val", "last_ts", "last_val"
    )


add("rollup_repair_late", late_points, SQL["rollup_1h"])
add(
    "stream_rollup_1h",
    lambda s, d, e=event_points: _streamed(s, d, e).withColumn("sum", F.round("sum", 6)).select(
        "series_id", "bucket_ts", "count", "sum", "min", "max", "first_ts", "first_val", "last_ts", "last_val"
    ),
    SQL["rollup_1h"],
)


def _streamed(spark, d, e=event_points):
    """Events taken up as a stream in several batches, each of which spans the whole time, so that most points of all
    but the first come days after later ones; the rollup merges them all."""
    from tagtide.operators.blocks import shared_folder
    from tagtide.streaming.rollups import ingested_rollup, start_ingest

    where = shared_folder(spark)
    static = e(spark, d)
    source = f"{where}/in"
    static.repartition(3, "seq").write.parquet(source)
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(source)
    start_ingest(stream, f"{where}/out", f"{where}/state", "1h").awaitTermination()
    return ingested_rollup(spark, f"{where}/out")


# ---- the same queries of events over one series per event type and user
E_USER_SQL = """SELECT 'events.value' AS metric, 'events.value{event_type=' || event_type || ',user_id='
 || coalesce(CAST(user_id AS VARCHAR), '') || '}' AS series_id, event_type, user_id, epoch_us(ts) // 1000000 AS ts,
 CAST(value AS DOUBLE) AS value, event_id AS seq FROM events"""
ON_EVENTS = [name for name in QUERIES if E_SQL in SQL.get(name, "")] + ["storage_stats"]
for name in ON_EVENTS:
    sql = SQL[name].replace(E_SQL, E_USER_SQL) if name in SQL else None
    if name.startswith("range_agg_"):
        # of many matched series the whole range is one row, as in range_auto_merge
        agg = name.removeprefix("range_agg_")
        sql = f"""WITH p AS ({E_USER_SQL}) SELECT 'events.value::__aggregate__' AS series_id, min(ts) AS bucket_ts,
 round({MERGE_SQL[agg]}, 6) AS value FROM (SELECT series_id, min(ts) AS ts, {AGG_SQL[agg]} AS value FROM p
 WHERE ts BETWEEN {A} AND {B} AND event_type = 'view' GROUP BY series_id) HAVING count(*) > 0"""
    add(f"{name}_by_user", partial(QUERIES[name], e=partial(event_points, with_user=True)), sql)

# ---- rollups that hold some granularities only, and what buckets are read from
add(
    "rollup_stitch_partial_store",
    lambda s, d: plain(from_rollup(event_points(s, d), QuerySpec(E_METRIC, {}, A, B, "sum", 21600), ("1m", "1h"))),
    round_sql(down_sql("e", "sum", 21600, A, B)),
)
add(
    "rollup_stitch_reads",
    lambda s, d: from_rollup(event_points(s, d), QuerySpec(E_METRIC, {}, A, B, "count", 21600), diagnostics=True)
    .groupBy("read").agg(F.count(F.lit(1)).alias("n_buckets"), F.sum("value").cast("bigint").alias("n_points")),
    with_p("e", f"""SELECT CASE WHEN bucket >= {A} AND bucket + 21599 <= {B} THEN 'rollup' ELSE 'points' END AS read,
 count(*) AS n_buckets, CAST(sum(n) AS BIGINT) AS n_points FROM (SELECT series_id, (ts // 21600) * 21600 AS bucket,
 count(*) AS n FROM p WHERE ts BETWEEN {A} AND {B} GROUP BY ALL) GROUP BY 1"""),
)
FINAL_SQL = {a: AGG_SQL[a] for a in AGGS}
for agg in AGGS:
    add(
        f"rollup_read_{agg}",
        lambda s, d, agg=agg: plain(read_rollup(build_rollup(order_points(s, d), ["6h", "1d"]), "1d", agg, OA, OB)),
        with_p("o", f"""SELECT series_id, bucket_ts, round(value, 6) AS value FROM (SELECT series_id,
 (ts // 86400) * 86400 AS bucket_ts, {FINAL_SQL[agg]} AS value FROM p GROUP BY ALL)
 WHERE bucket_ts >= {OA} AND bucket_ts + 86400 <= {OB}"""),
    )


def missing_orders(spark, d):
    points = order_points(spark, d)
    matched = catalog.match_series(catalog.series_dimension(points), O_METRIC)
    return missing_counts(query(points, QuerySpec(O_METRIC, {}, OA, OB, "sum", 86400), series=matched), matched)


add(
    "cross_missing",
    missing_orders,
    with_p("o", f"""SELECT (ts // 86400) * 86400 AS bucket_ts, count(DISTINCT series_id) AS n_present,
 (SELECT count(DISTINCT series_id) FROM p) - count(DISTINCT series_id) AS n_missing FROM p
 WHERE ts BETWEEN {OA} AND {OB} GROUP BY 1""").replace("(ts // 86400) * 86400 AS", f"greatest((ts // 86400) * 86400, {OA}) AS"),
)
add(
    "tags_of_series",
    lambda s, d: catalog.tags_of_series(
        catalog.series_dimension(order_points(s, d)), "orders.totalprice{o_orderpriority=1-URGENT,o_orderstatus=F}"
    ).select("series_id", F.explode("tags").alias("tag_key", "tag_value")),
    with_p("o", """SELECT DISTINCT series_id, unnest(['o_orderstatus', 'o_orderpriority']) AS tag_key,
 unnest([o_orderstatus, o_orderpriority]) AS tag_value FROM p
 WHERE series_id = 'orders.totalprice{o_orderpriority=1-URGENT,o_orderstatus=F}'"""),
)


def spread_by_day(spark, d):
    """A registered aggregate beside the named ones: the range of the values of a bucket."""
    if "spread" not in AGGREGATES:
        register("spread", lambda v, o: F.max(v) - F.min(v), merge=lambda: F.max("max") - F.min("min"))
    return plain(from_rollup(event_points(spark, d), QuerySpec(E_METRIC, {}, A, B, "spread", 86400)))


add(
    "register_aggregate",
    spread_by_day,
    with_p("e", f"""SELECT series_id, greatest((ts // 86400) * 86400, {A}) AS bucket_ts,
 round(max(value) - min(value), 6) AS value FROM p WHERE ts BETWEEN {A} AND {B} GROUP BY ALL"""),
)
add(
    "wide_points",
    lambda s, d: wide_to_points(
        table(s, d, "lineitem"), epoch_seconds(F.col("l_shipdate")), F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        {"flag": F.col("l_returnflag")}, {"line.quantity": "l_quantity", "line.price": "l_extendedprice"},
    ).groupBy("metric", "series_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max("value").alias("max_value")
    ),
    " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, '{m}{{flag=' || l_returnflag || '}}' AS series_id, count(*) AS n_points,
 min(epoch_us(l_shipdate) // 1000000) AS min_ts, max(epoch_us(l_shipdate) // 1000000) AS max_ts,
 max(CAST({c} AS DOUBLE)) AS max_value FROM lineitem WHERE {c} IS NOT NULL GROUP BY l_returnflag"""
        for m, c in (("line.quantity", "l_quantity"), ("line.price", "l_extendedprice"))
    ),
)
add(
    "value_codec_exact",
    lambda s, d: codec.unseal(codec.seal(chunks.chunked(order_points(s, d)))).select("series_id", "ts", "value"),
    with_p("o", "SELECT series_id, ts, value FROM p"),
)
add(
    "storage_totals",
    lambda s, d: chunks.ts_sizes(chunks.chunked(line_points(s, d))).agg(
        F.sum("n_points").alias("n_points"), (F.sum("n_points") * chunks.RAW_POINT_BYTES).alias("raw_bytes"),
        F.sum("ts_bytes").alias("ts_bytes"), F.count_distinct("series_id").alias("n_series"),
    ),
    f"""SELECT CAST(sum(n_points) AS BIGINT) AS n_points, CAST(sum(n_points) * 16 AS BIGINT) AS raw_bytes,
 CAST(sum(ts_bytes) AS BIGINT) AS ts_bytes, count(DISTINCT series_id) AS n_series FROM ({SQL["ts_compressed_size"]})""",
)


def through_store(spark, d):
    """Points written to a store partitioned by metric and day and read back through a pruned range scan."""
    from tagtide.operators.blocks import shared_folder

    where = f"{shared_folder(spark)}/store"
    write_points(event_points(spark, d), where)
    return plain(query(read_points(spark, where), QuerySpec(E_METRIC, {}, A, B, "avg", 1800)))


add("store_roundtrip", through_store, round_sql(down_sql("e", "avg", 1800, A, B)))

__all__ = ["QUERIES", "SQL", "Window", "in_range"]
