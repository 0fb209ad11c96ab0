"""Downsampling, labels and cross-series results against golden values and a naive full scan."""

import pytest
from pyspark.sql import functions as F

from tagtide import QuerySpec, query
from tagtide.operators import catalog
from tagtide.operators.downsample import downsample
from tagtide.operators.rollup import build_rollup, contained, rollup_stats
from tagtide.operators.scan import range_scan
from tagtide.plans.spec import coarsest_within
from tests.points import B, collect, gauss, line, make, slots, wave

AGGS = ("sum", "avg", "min", "max", "count", "first", "last")


def naive(rows, interval, agg, a, b):
    held = {}
    for i, (_, t, v) in enumerate(rows):
        if a <= t <= b:
            held.setdefault(max(t // interval * interval, a), []).append((t, i, float(v)))
    out = []
    for k in sorted(held):
        vs = [v for _, _, v in sorted(held[k])]
        f = {"sum": sum(vs), "avg": sum(vs) / len(vs), "min": min(vs), "max": max(vs), "count": float(len(vs)),
             "first": vs[0], "last": vs[-1]}
        out.append((k, f[agg]))
    return out


def run(spark, rows, interval, agg, a, b, **kw):
    p = make(spark, rows)
    series = catalog.series_dimension(p)
    g = coarsest_within(interval)
    rollup = build_rollup(p, [g[0]]) if g else None
    direct = query(p, QuerySpec("cpu", {}, B + a, B + b, agg, interval, **kw))
    stitched = query(p, QuerySpec("cpu", {}, B + a, B + b, agg, interval, **kw), series, rollup, stored=g and (g[0],))
    one = [(t - B, v, s) for t, v, s in collect(direct, "bucket_ts", "value", "source")]
    two = [(t - B, v, s) for t, v, s in collect(stitched, "bucket_ts", "value", "source")]
    assert [x[0] for x in one] == [x[0] for x in two] and all(x[2] == "raw" for x in one)
    assert [x[1] for x in one] == pytest.approx([x[1] for x in two], abs=1e-9)
    assert all(a <= t <= b for t, _, _ in one)
    return two


CASES = [
    (line({"host": "srv1"}, 2160, 100, 0.01), (60, 300, 900, 1800, 3600), (2220, 10380)),
    (wave({"host": "srv3"}, 360, 100, 50, 0.1), (60,), (125, 789)),
    (gauss({"host": "srv4"}), (1800, 7200), (3737, 17749)),
    (line({"host": "srv6"}, 2000, 100, 0.01), (10, 5400), (2220, 6780)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("agg", AGGS)
def test_equals_naive_scan(spark, case, agg):
    rows, intervals, (a, b) = CASES[case]
    for interval in intervals[:: 2 if agg not in ("avg", "last") else 1]:
        got = run(spark, rows, interval, agg, a, b)
        want = naive(rows, interval, agg, a, b)
        # B is aligned to every granularity, so offsets bucket alike, except for intervals that do not divide it
        if B % interval == 0:
            assert [g[0] for g in got] == [w[0] for w in want]
            assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_golden_labels(spark):
    got = run(spark, line({"host": "srv1"}, 2160, 100, 0.01), 1800, "avg", 2220, 10380)
    assert [s for _, _, s in got] == ["raw", "pre_agg:n", "pre_agg:n", "pre_agg:n", "raw"]
    assert got[0][:2] == (2220, pytest.approx(102.905)) and got[-1][:2] == (9000, pytest.approx(109.69))
    got = run(spark, slots({"host": "srv7"}), 1800, "avg", 3600, 10799)
    assert len(got) == 4 and {s for _, _, s in got} == {"pre_agg:n"}
    assert [v for _, v, _ in got] == pytest.approx([14.285714285714286] * 4)
    got = run(spark, wave({"host": "srv10"}, 1080, 40, 10, 0.05), 1800, "avg", 600, 4800)
    assert [s for _, _, s in got] == ["raw", "pre_agg:n", "raw"]
    assert got[0][1] == pytest.approx(39.85729872278588) and got[2][1] == pytest.approx(40.321775807079895)
    got = run(spark, line({"host": "srv6"}, 2000, 100, 0.01), 10, "avg", 0, 100)
    assert {s for _, _, s in got} == {"raw"}


def hosts(n, base, amp_w=0.1, regions=None):
    rows = []
    for i in range(n):
        tags = {"host": f"web-0{i + 1}", "region": (regions or ["us-east"] * n)[i], "service": "api"}
        rows += wave(tags, 360, base * (i + 1), 1, amp_w)
    return rows


@pytest.mark.parametrize(
    "cross,want",
    [("sum", (60.06282492291587, 60.133277161394005)), ("avg", (20.02094164097196, 20.04442572046467)),
     ("min", (10.020941640971957, 10.044425720464668)), ("max", (30.02094164097196, 30.044425720464666)),
     ("count", (3, 3)), ("first", (10.020941640971957, 10.044425720464668)),
     ("last", (30.02094164097196, 30.044425720464666))],
)
def test_cross_series(spark, cross, want):
    df = query(make(spark, hosts(3, 10)), QuerySpec("cpu", {}, B, B + 3599, "avg", 1800, cross))
    got = collect(df, "bucket_ts", "value", "source")
    assert [g[0] - B for g in got] == [0, 1800] and [g[1] for g in got] == pytest.approx(want)
    assert {g[2] for g in got} == {"cross_merged"}


def test_group_by_tag(spark):
    p = make(spark, hosts(5, 10, 0.05, ["us-east"] * 2 + ["eu-west"] * 3))
    for series in (None, catalog.series_dimension(p)):
        df = query(p, QuerySpec("cpu", {}, B, B + 3599, "avg", 1800, "avg", "region"), series=series)
        got = {(r.series_id, r.bucket_ts - B): r.value for r in df.collect()}
        assert got[("cpu::region=us-east", 0)] == pytest.approx(15.211158792336121)
        assert got[("cpu::region=eu-west", 1800)] == pytest.approx(39.82866200795543)
        assert len(got) == 4
    assert query(p, QuerySpec("cpu", {}, B, B + 3599, "avg", 1800, "avg", "rack")).count() == 0
    east = query(p, QuerySpec("cpu", {"region": "us-east"}, B + 600, B + 3599, "avg", 1800, "avg"))
    got = collect(east, "bucket_ts", "value")
    assert [g[0] - B for g in got] == [600, 1800]
    assert [g[1] for g in got] == pytest.approx([14.985729872278586, 14.82866200795543])


def test_missing_series_and_sources(spark):
    tags = lambda h: {"host": h, "service": "api"}
    rows = [(tags("full"), i * 10, 10) for i in range(720)] + [(tags("partial-early"), i * 10, 20) for i in range(180)]
    rows += [(tags("partial-late"), 3600 + i * 10, 30) for i in range(180)] + [(tags("sparse"), i, 100) for i in range(10)]
    p = make(spark, rows)
    rollup = build_rollup(p, ["15m"])
    df = query(p, QuerySpec("cpu", {}, B, B + 7199, "avg", 1800, "avg"), catalog.series_dimension(p), rollup, diagnostics=True)
    got = collect(df, "bucket_ts", "value", "series_sources")
    assert [g[1] for g in got] == pytest.approx([43.333333333333336, 10.0, 20.0, 10.0])
    short = {k.split("=")[1].split(",")[0]: v for k, v in got[0][2].items()}
    assert short == {"full": "pre_agg:n", "partial-early": "pre_agg:n", "partial-late": "missing", "sparse": "raw"}


def test_average_of_averages_and_auto_merge(spark):
    rows = [({"host": "A", "service": "api"}, i, 10) for i in range(100)]
    rows += [({"host": "B", "service": "api"}, i * 60, 100) for i in range(5)]
    p = make(spark, rows)
    df = query(p, QuerySpec("cpu", {}, B, B + 1799, "avg", 1800, "avg"))
    assert collect(df, "value") == [(55.0,)]
    merged = query(p, QuerySpec("cpu", {}, B, B + 1799, "count")).collect()
    assert [(r.series_id, r.bucket_ts, r.value) for r in merged] == [("cpu::__aggregate__", B, 2.0)]
    assert query(p, QuerySpec("cpu", {"host": "none"}, agg="sum")).count() == 0
    assert query(p, QuerySpec("cpu", {}, agg="avg", interval=3600)).count() == 2  # open range ends
    assert query(p, QuerySpec("cpu", {"host": "A"})).count() == 100


def test_order_of_arrival_does_not_matter(spark):
    rows = wave({"host": "srv3"}, 360, 100, 50, 0.1)
    back = rows[::-1] + rows[:5]
    fwd = query(make(spark, rows), QuerySpec("cpu", {}, agg="first", interval=60)).collect()
    rev = query(make(spark, back), QuerySpec("cpu", {}, agg="first", interval=60)).collect()
    assert sorted((r.bucket_ts, r.value) for r in fwd) == sorted((r.bucket_ts, r.value) for r in rev)


def test_tag_predicates(spark):
    rows = [({"host": f"web-0{i}", **({"env": "staging"} if i == 1 else {})}, 0, i) for i in range(1, 4)]
    p = make(spark, rows)
    s = catalog.series_dimension(p)
    posts = catalog.tag_postings(s)

    def ids(filters):
        one = {r.series_id for r in catalog.match_series(s, "cpu", filters).collect()}
        two = {r.series_id for r in catalog.match_by_postings(s, posts, "cpu", filters).collect()}
        assert one == two
        return {i.split("host=")[1].rstrip("}") for i in one}

    assert ids({"env": ("!=", "staging")}) == {"web-02", "web-03"}
    assert ids({"host": ("=~", "eb-0[12]")}) == {"web-01", "web-02"}
    assert ids({"host": ("=~", "eb-0[12]"), "env": ("!=", "staging")}) == {"web-02"}
    assert ids({}) == {"web-01", "web-02", "web-03"} and ids({"host": "x"}) == set()
    assert catalog.tags_of_series(s, "unknown").count() == 0


def test_series_ids_do_not_collide(spark):
    p = make(spark, [({"a": "1,b=2"}, 0, 1), ({"a": "1", "b": "2"}, 0, 1), ({}, 0, 1), ({"a": "x"}, 0, 1), ({"a": r"\x"}, 0, 1)])
    assert p.select("series_id").distinct().count() == 5


@pytest.mark.parametrize(
    "kw",
    [{"agg": "median"}, {"cross_agg": "avg"}, {"interval": 0}, {"interval": -5}, {"group_by": "x", "interval": 60},
     {"tag_filters": {"a": (">", "b")}}, {"tag_filters": {"a": 3}}, {"interval": 60, "cross_agg": "nope"}],
)
def test_bad_queries_raise(kw):
    with pytest.raises(ValueError):
        QuerySpec("cpu", **kw)


def test_rollup_counts_and_containment(spark):
    p = make(spark, [({"h": "a"}, i * 10 - 6400, 1.0) for i in range(8640)])
    stats = {r.granularity: r.n_rows for r in rollup_stats(build_rollup(p)).collect()}
    assert stats == {"1m": 1441, "5m": 289, "15m": 97, "1h": 25, "6h": 5, "1d": 2}
    r = build_rollup(p, ["1h"])
    kept = contained(r, "1h", B + 1, B + 3 * 3600).select("bucket_ts").collect()
    assert sorted(x.bucket_ts - B for x in kept) == [3600, 7200]


def test_negative_times_floor(spark):
    df = spark.createDataFrame([("cpu", "s", -7, 1.0, 0), ("cpu", "s", 3, 2.0, 1)], "metric string, series_id string, ts long, value double, seq long")
    got = {r.bucket_ts for r in downsample(df, "sum", 5).collect()}
    assert got == {-10, 0}


def test_incomplete_rollups_use_points(spark):
    rows = line({"host": "x"}, 720, 0, 1)
    p = make(spark, rows)
    early = make(spark, rows[:400])
    out = query(p, QuerySpec("cpu", {}, B, B + 7199, "sum", 1800), catalog.series_dimension(p), build_rollup(early, ["15m"]), complete_through=B + 3599)
    want = query(p, QuerySpec("cpu", {}, B, B + 7199, "sum", 1800))
    assert sorted((r.bucket_ts, r.value) for r in out.collect()) == sorted((r.bucket_ts, r.value) for r in want.collect())
    assert [r.source for r in out.orderBy("bucket_ts").collect()] == ["pre_agg:n"] * 2 + ["raw"] * 2


def test_null_times_and_values_are_no_points(spark):
    df = spark.createDataFrame([("cpu", "s", None, 1.0, 0), ("cpu", "s", 3, None, 1), ("cpu", "s", 4, 2.0, 2)], "metric string, series_id string, ts long, value double, seq long")
    assert range_scan(df).count() == 1 and range_scan(df.limit(0)).count() == 0
    assert downsample(range_scan(df.limit(0)), "avg", 60).where(F.lit(True)).count() == 0


def test_known_keys_give_the_same_ids(spark):
    from tagtide.functions.columns import series_id, series_id_of

    df = spark.createDataFrame([("a,b", "x=\\y"), (None, "{}"), ("", "plain")], "p string, q string")
    tags = {"q": F.col("q"), "p": F.col("p"), "k=1": F.lit("v")}
    made = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), v)])
    rows = df.select(series_id_of("m", tags).alias("a"), series_id(F.lit("m"), made).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) == 3


def test_order_keys():
    from pyspark.sql import SparkSession

    from tagtide.functions.columns import ORDER_SPAN, order_key, order_offset, order_seq

    spark = SparkSession.getActiveSession()
    rows = [(o, s) for o in (0, 1, 86399, ORDER_SPAN - 1) for s in (-(2**63) + 1, -1, 0, 5, 2**63 - 1)] + [(7, None)]
    key = order_key(F.col("o"), F.col("s"))
    got = spark.createDataFrame(rows, "o long, s long").select("o", "s", key.alias("k"))
    back = got.select("o", "s", order_offset(F.col("k")).alias("o2"), order_seq(F.col("k")).alias("s2")).collect()
    assert all(r.o == r.o2 and r.s == r.s2 for r in back)
    ordered = [(r.o, r.s) for r in got.orderBy("k").collect()]
    assert ordered == sorted(rows, key=lambda r: (r[0], -(2**64) if r[1] is None else r[1]))


SUBSETS = [("1m",), ("5m",), ("15m",), ("1h",), ("6h",), ("1m", "1h"), ("5m", "6h"), ("1m", "5m", "15m", "1h", "6h", "1d"), ("1h", "1d")]


@pytest.mark.parametrize("stored", SUBSETS)
@pytest.mark.parametrize("given", [True, False])
def test_stitching_uses_what_is_stored(spark, stored, given):
    p = make(spark, gauss({"host": "a"}, 8640) + line({"host": "b"}, 700, 5, 1, step=97))
    s, rollup = catalog.series_dimension(p), build_rollup(p, stored)
    for agg in ("sum", "last", "first"):
        spec = QuerySpec("cpu", {}, B + 3737, B + 79_000, agg, 21600)
        out = query(p, spec, s, rollup, stored=stored if given else None, diagnostics=True).collect()
        want = {(r.series_id, r.bucket_ts): r.value for r in query(p, spec).collect()}
        assert {(r.series_id, r.bucket_ts): pytest.approx(r.value) for r in out} == want and len(want) > 5
        assert {r.read for r in out} == {"rollup", "points"}
        # bucket 21600 of host a is whole in every store
        label = {r.source for r in out if "host=a" in r.series_id and r.bucket_ts == B + 21600}
        assert label == {"pre_agg:1" if "6h" in stored else "pre_agg:n"}


def test_stitching_without_a_fitting_granularity(spark):
    p = make(spark, line({"host": "a"}, 3000, 5, 1))
    s = catalog.series_dimension(p)
    for stored in (None, ("1d",)):
        with pytest.raises(ValueError):
            query(p, QuerySpec("cpu", {}, B, B + 29_999, "sum", 21600), s, build_rollup(p, ["1d"]), stored=stored)
    spec = QuerySpec("cpu", {}, B, B + 29_999, "sum", 3600)
    want = sorted(map(tuple, query(p, spec).collect()))
    none = build_rollup(p, ["1h"]).where("false")  # a store without rows of the metric leaves all to the points
    assert sorted(map(tuple, query(p, spec, s, none).collect())) == want
    odd = QuerySpec("cpu", {}, B, B + 29_999, "sum", 5400)  # no coarsest granularity divides it: points, as ever
    assert {r.source for r in query(p, odd, s, build_rollup(p, ["1d"])).collect()} == {"raw"}


def test_many_series_need_the_long_form(spark):
    from tagtide.operators.crossseries import cross_sources, missing_counts

    p = make(spark, line({"host": "a"}, 20, 5, 1) + line({"host": "b"}, 400, 5, 1))
    s = catalog.series_dimension(p)
    per = query(p, QuerySpec("cpu", {}, B, B + 9999, "sum", 60), s)
    assert {r.n_missing for r in missing_counts(per, s).collect()} == {0, 1}
    assert all(len(r.series_sources) == 2 for r in cross_sources(per, s, limit=2).collect())
    with pytest.raises(Exception, match="more than 1 series"):
        cross_sources(per, s, limit=1).collect()


def test_a_cluster_needs_a_shared_folder():
    from tagtide.operators import blocks

    assert blocks._local_folder("local[4]").startswith("file:") and blocks._local_folder("local").startswith("file:")
    for master in ("local-cluster[3,2,1024]", "spark://h:7077", "yarn", "k8s://https://h"):
        with pytest.raises(ValueError):
            blocks._local_folder(master)


def test_written_tables_are_released(spark):
    from tagtide.operators.blocks import release, written

    release(spark)
    made = written(spark.range(5))
    assert made.count() == 5 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception):
        made.count()


def test_too_many_series_raise(spark):
    from tagtide.operators.result import nested

    p = make(spark, line({"host": "a"}, 1, 5, 1) + line({"host": "b"}, 1, 5, 1))
    with pytest.raises(ValueError, match="series"):
        nested(query(p, QuerySpec("cpu", {"host": "a"})), catalog.series_dimension(p), limit=1)
