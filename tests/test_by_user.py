"""Event queries over one series per event type and user, the mapping of SURVEY 7.5, against their SQL."""

import duckdb
import pytest

from tagtide.queries import ON_EVENTS, QUERIES, SQL


def rows(found):
    return sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in found)


def test_every_event_query_has_one_by_user():
    assert len(ON_EVENTS) == 47 and all(f"{name}_by_user" in QUERIES for name in ON_EVENTS)


@pytest.mark.parametrize(
    "name",
    ["raw_range_scan", "tag_neq", "range_agg_last", "downsample_avg", "rollup_1h", "rollup_stitch_avg", "cross_sum", "cross_first",
     "query_stats", "chunk_prune", "value_codec_roundtrip", "rollup_repair_late", "stream_rollup_1h"],
)
def test_by_user_equals_sql(spark, sf, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    made = QUERIES[f"{name}_by_user"](spark, sf)
    answer = db.sql(SQL[f"{name}_by_user"])
    want = rows(answer.project(", ".join(made.columns)).fetchall())
    assert want and rows(map(tuple, made.collect())) == want


def test_series_are_of_one_type_and_user(spark, sf):
    db = duckdb.connect()
    pairs = db.sql(f"SELECT count(*) FROM (SELECT DISTINCT event_type, user_id FROM '{sf}/events.parquet')").fetchall()[0][0]
    made = QUERIES["rollup_1d_by_user"](spark, sf)
    assert made.select("series_id").distinct().count() == pairs > 5
