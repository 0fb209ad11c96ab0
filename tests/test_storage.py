"""Chunks, codec, stores, plans and streams."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagtide import QuerySpec, query
from tagtide.operators import chunks, codec
from tagtide.operators.catalog import series_dimension
from tagtide.operators.result import nested, query_stats
from tagtide.operators.rollup import build_rollup
from tagtide.operators.scan import range_scan
from tagtide.sources.tables import event_points, read_points, wide_to_points, write_points, write_text_points
from tests.points import B, line, make


def test_code_lengths():
    for step, bits in zip((-64, -63, 64, 65, 256, 257, 2048, 2049, 32768, 32769), (12, 9, 9, 12, 12, 16, 16, 21, 21, 38)):
        ts = np.array([0, 100_000, 200_000, 300_000 + step])
        assert math.ceil((64 + 65 + 1 + bits) / 8) == len(codec.encode_times(ts))
        assert codec.decode_times(codec.encode_times(ts), 4).tolist() == ts.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=30))
def test_times_round_trip(ts):
    assert codec.decode_times(codec.encode_times(np.array(ts, np.int64)), len(ts)).tolist() == ts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(), max_size=40))
def test_values_round_trip(values):
    v = np.array(values, float)
    assert codec.decode_values(codec.encode_values(v), len(v)).view(np.uint64).tolist() == v.view(np.uint64).tolist()


def test_special_values():
    v = np.array([0.0, -0.0, math.nan, math.inf, -math.inf, 5.5, 5.5, 5.5, -5.5, 5.5, 5e-324])
    assert codec.decode_values(codec.encode_values(v), len(v)).view(np.uint64).tolist() == v.view(np.uint64).tolist()
    with pytest.raises(EOFError):
        codec.decode_values(b"\x00", 3)


def test_regular_times_are_small():
    assert len(codec.encode_times(np.arange(10_000) * 10)) == 1266


def test_chunking_matches_codec(spark):
    rng = random.Random(3)
    rows = [({"h": "a"}, i * 10 + rng.randrange(3), rng.gauss(0, 1)) for i in range(7300)]
    cut = chunks.chunked(make(spark, rows), width=1000).cache()
    stats = {r.chunk_id: r for r in chunks.chunk_stats(cut).collect()}
    assert {k: r.n_points for k, r in stats.items()} == {0: 3600, 1: 3600, 2: 100}
    assert [stats[i].sealed for i in range(3)] == [True, True, False]
    sizes = {r.chunk_id: r.ts_bytes for r in chunks.ts_sizes(cut).collect()}
    sealed = codec.seal(cut).cache()
    assert {r.chunk_id: len(r.ts_blob) for r in sealed.collect()} == sizes
    back = codec.unseal(sealed, B + 5000, B + 6000).collect()
    want = sorted((B + t, v) for _, t, v in rows if 5000 <= t <= 6000)
    assert sorted((r.ts, r.value) for r in back) == want
    assert chunks.prune(chunks.chunk_stats(cut), B, B + 10).count() == 1
    total = chunks.storage_stats(sealed).collect()[0]
    assert total.n_points == 7300 and total.raw_bytes == 7300 * 16 and total.ratio > 1


def test_store_prunes_days_and_pushes_time(spark, tmp_path):
    path = str(tmp_path / "store")
    write_points(make(spark, line({"h": "a"}, 500, 0, 1, step=3600)), path)
    stored = read_points(spark, path)
    kept = range_scan(stored.where(F.col("metric") == "cpu"), B + 86400, B + 2 * 86400)
    plan = kept._jdf.queryExecution().toString()
    assert "day" in plan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(ts" in plan
    assert kept.count() == 25


@pytest.mark.parametrize("form", ["json", "csv"])
def test_text_forms(spark, tmp_path, form):
    p = make(spark, line({"h": "a,b", "k": "v"}, 5, 0, 1))
    write_text_points(p, str(tmp_path / form), form)
    back = read_points(spark, str(tmp_path / form), form)
    cols = ["metric", "series_id", "ts", "value", "seq", F.col("tags")["h"].alias("h")]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, p.select(*cols).collect()))
    with pytest.raises(ValueError):
        read_points(spark, "x", "nope")


def test_wide_rows(spark):
    df = spark.createDataFrame([(1, 10, 1.0, None), (2, 20, 2.0, 3.0)], "id long, t long, a double, b double")
    out = wide_to_points(df, F.col("t"), F.col("id"), {"src": F.lit("x")}, {"m.a": "a", "m.b": "b"})
    assert sorted((r.series_id, r.ts, r.value) for r in out.collect()) == [("m.a{src=x}", 10, 1.0), ("m.a{src=x}", 20, 2.0), ("m.b{src=x}", 20, 3.0)]


def test_result_objects(spark):
    p = make(spark, line({"h": "a"}, 50, 0, 1) + line({"h": "b"}, 1, 0, 1, start=99_999))
    spec = QuerySpec("cpu", {}, B, B + 499, "avg", 60)
    out = query(p, spec, series_dimension(p), build_rollup(p, ["1m"]))
    shown = nested(out, series_dimension(p))
    assert [s.series_id for s in shown] == ["cpu{h=a}", "cpu{h=b}"] and shown[1].points == []
    assert "+4 more" in repr(shown[0])
    stats = query_stats(out, 60).collect()[0]
    assert stats.total_buckets == 9 and stats.source_granularity == "1m" and 0 < stats.pre_agg_hit_ratio <= 1
    with pytest.raises(ValueError):
        nested(out, limit=2)


def test_stream_equals_batch(spark, sf, tmp_path):
    from tagtide.streaming.rollups import compact, newest, start_rollup

    p = event_points(spark, sf)
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_rollup(stream, "6h", str(tmp_path / "out"), str(tmp_path / "cp"), "60 days").awaitTermination()
    compact(spark.read.parquet(str(tmp_path / "out")), str(tmp_path / "done"))
    cols = ["series_id", "bucket_ts", "count", "min", "max", "first_val", "last_val"]
    want = sorted(map(tuple, build_rollup(p, ["6h"]).select(*cols).collect()))
    assert sorted(map(tuple, newest(spark.read.parquet(str(tmp_path / "out"))).select(*cols).collect())) == want
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "done")).select(*cols).collect())) == want


def test_late_points_are_taken_up(spark, sf, tmp_path):
    """Three batches that all span the month; the first day of the second is weeks late."""
    from tagtide.streaming import rollups

    p = event_points(spark, sf)
    p.repartition(3, "seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    assert rollups.arrived(spark, out).count() == 0
    rollups.start_ingest(stream, out, str(tmp_path / "cp"), "1h").awaitTermination()
    told = rollups.arrived(spark, out).collect()
    n, last = p.count(), p.agg(F.max("ts")).first()[0]
    assert [(r.metric, r.complete_through, r.n_points) for r in told] == [("events.value", last - 3600, n)] and told[0].n_late > n / 3
    cols = ["series_id", "bucket_ts", "count", "min", "max", "first_ts", "first_seq", "first_val", "last_ts", "last_seq", "last_val"]
    want = sorted(map(tuple, build_rollup(p, ["1h"]).select(*cols).collect()))
    partials = spark.read.parquet(f"{out}/rollup")
    assert partials.count() > len(want)
    made = rollups.ingested_rollup(spark, out)
    assert sorted(map(tuple, made.select(*cols).collect())) == want
    assert made.agg(F.sum("sum")).first()[0] == pytest.approx(p.agg(F.sum("value")).first()[0])
    rollups.compact_merged(spark, out, str(tmp_path / "done"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "done")).select(*cols).collect())) == want
    # points, rollup and the time up to which points arrived serve one stitched query
    stored = rollups.ingested_points(spark, out)
    spec = QuerySpec("events.value", {}, 1704071521, last, "last", 7200)
    out_ = query(stored, spec, series_dimension(stored), made, told[0].complete_through, stored=("1h",))
    same = query(p, spec)
    assert sorted(map(tuple, out_.select("series_id", "bucket_ts", "value").collect())) == sorted(map(tuple, same.select("series_id", "bucket_ts", "value").collect()))
    with pytest.raises(ValueError):
        rollups.merged(build_rollup(p, ["1h", "1d"]))


def test_repair_prunes_days(spark, tmp_path):
    from tagtide.streaming.rollups import repair

    rows = line({"h": "a"}, 400, 0, 1, step=3600)
    path = str(tmp_path / "store")
    write_points(make(spark, rows), path)
    stored = read_points(spark, path)
    late = stored.where(F.col("ts") == B + 36_000)
    early = build_rollup(make(spark, rows[:10] + rows[11:]), ["6h"])
    got = repair(early, stored, late, "6h")
    assert got.where(F.col("bucket_ts") == B + 21_600).first()["count"] == 6 and got.count() == early.count()
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()
