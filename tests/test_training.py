"""Trailing totals, regular grids and implausible readings against brute force, and their edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtide.operators import grid, spikes, trailing
from tagtide.operators.blocks import numbered

SCHEMA = (
    "metric string, series_id string, tags map<string,string>, ts long, value double, seq long, "
    "kind string, block long, n1 long, slot long, interval_s long"
)
CATALOG = "metric string, kind string, unit string, interval_s long, low_limit double, high_limit double, value double"
NAN = float("nan")


def catalog(spark):
    rows = [
        ("g", "gauge", "u", 60, 0.0, 100.0, 1.0), ("free", "gauge", "u", 60, None, None, 1.0),
        ("d", "delta", "u", None, None, None, 1.0), ("odd", "gauge", "u", None, None, 5.0, 1.0),
    ]
    return spark.createDataFrame(rows, CATALOG)


def points(spark, rows):
    """(series_id, ts, value) with clashing extra columns."""
    made = [("x", s, None, t, v, i, "gauge", 7, 7, 7, 7) for i, (s, t, v) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


DIRT = [(None, 5, 1.0), ("d{}", None, 1.0), ("d{}", 5, None), ("d{}", 5, NAN), ("unknown{}", 5, 1.0), ("g{}", 5, None),
        ("g{}", None, 1.0), ("g{}", 90, NAN)]


# ---- trailing totals
def brute_days(rows, windows=(7, 30)):
    out = {}
    by = defaultdict(lambda: defaultdict(list))
    for s, t, v in {r for r in rows if None not in r and r[2] == r[2] and r[0].startswith("d{")}:
        by[s][t // 86400].append(v)
    for s, days in by.items():
        for day in range(min(days), max(days) + 1):
            row = []
            for w in windows:
                held = [v for k in range(day - w + 1, day + 1) for v in days.get(k, [])]
                row += [len(held), sum(held)]
            out[(s, day)] = tuple(row)
    return out


def test_trailing_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"d{{h={rng.randrange(4)}}}", rng.randrange(-20, 90) * 86400 + rng.randrange(86400), float(rng.randrange(-5, 9))) for _ in range(160)]
    rows += rows[:40] + DIRT + [("d{h=one}", 86400 * 3, 2.0)]
    got = trailing.activity(points(spark, rows), catalog(spark))
    found = {(r.series_id, r.day_no): (r.n_7, r.sum_7, r.n_30, r.sum_30) for r in got.collect()}
    assert found == brute_days(rows)
    r = got.where("series_id = 'd{h=one}'").collect()
    assert len(r) == 1 and r[0].avg_7 == pytest.approx(2 / 7) and r[0].sum_30 == 2.0


def test_trailing_marks(spark):
    day = 86400
    steady = [("d{h=a}", d * day, 1.0) for d in range(40)] + [("d{h=a}", d * day, 1.0) for d in range(50, 52)]
    surge = [("d{h=b}", d * day + i, 1.0) for d in range(36) for i in range(10 if d >= 33 else 1)]
    got = {tuple(r) for r in trailing.activity_marks(points(spark, steady + surge), catalog(spark)).collect()}
    want = set()
    for (s, d), (n7, s7, n30, s30) in brute_days(steady + surge).items():
        if d >= 29:
            if n7 == 0 and n30 > 0:
                want.add((s, d, "quiet"))
            elif s30 > 0 and s7 / 7 > 2.5 * s30 / 30:
                want.add((s, d, "surge"))
    assert got == want and {m for _, _, m in want} == {"quiet", "surge"}


@pytest.mark.parametrize("window", [1, 2, 5, 16, 31])
def test_any_window(spark, window):
    rows = [("d{}", d * 86400, float(d)) for d in (0, 1, 4, 9, 40)]
    days = trailing.dense_days(trailing.daily(points(spark, rows)))
    got = {r.day_no: r[f"sum_{window}"] for r in trailing.trailing(days, (window,)).collect()}
    assert got == {d: sum(v for _, t, v in rows if d - window < t // 86400 <= d) for d in range(41)}
    with pytest.raises(ValueError):
        trailing.trailing(days, (0,))


def test_trailing_empty(spark):
    assert trailing.activity(points(spark, []), catalog(spark)).count() == 0
    assert trailing.activity_marks(points(spark, DIRT), catalog(spark)).count() == 0


# ---- grid
def test_grid_slots_and_values(spark):
    rows = [("g{a}", t, v) for t, v in [(0, 1.0), (61, 2.0), (62, 3.0), (62, 3.5), (300, 8.0), (300, 8.0)]]
    rows += [("g{a}", 300 + 8 * 86400, 5.0), ("g{one}", 17, 4.0)] + DIRT
    got = {(r.series_id, r.slot_ts): (r.value, r.missing) for r in grid.regular_grid(points(spark, rows), catalog(spark)).collect()}
    # the off time of more than 7 days has no rows; the last written of two equal times stands
    assert set(got) == {("g{a}", t) for t in (0, 60, 120, 180, 240, 300, 300 + 8 * 86400)} | {("g{one}", 0)}
    assert got[("g{a}", 60)] == (3.5, False) and got[("g{a}", 0)] == (1.0, False) and got[("g{one}", 0)] == (4.0, False)
    assert all(got[("g{a}", t)][1] for t in (120, 180, 240))
    assert {(r.series_id, r.slot_ts) for r in grid.missing_slots(points(spark, rows), catalog(spark)).collect()} == {("g{a}", t) for t in (120, 180, 240)}


def test_grid_gap_over_several_blocks(spark):
    rows = [("free{}", 0, 1.0), ("free{}", 60 * 2000, 3.0)]
    got = grid.missing_slots(points(spark, rows), catalog(spark)).collect()
    assert sorted(r.slot_ts for r in got) == [60 * i for i in range(1, 2000)]
    exact = [("free{}", 0, 1.0), ("free{}", 7 * 86400, 3.0)]
    assert grid.missing_slots(points(spark, exact), catalog(spark)).count() == 7 * 1440 - 1
    assert grid.missing_slots(points(spark, [exact[0], ("free{}", 7 * 86400 + 60, 3.0)]), catalog(spark)).count() == 0


def test_grid_estimates_held_out_values(spark):
    rng = random.Random(1)
    true = lambda t: 40 + 8 * math.sin(2 * math.pi * t / 86400) + 2 * math.cos(4 * math.pi * t / 86400) + t / 86400
    times = [60 * k for k in range(5 * 1440)]
    gone = set()
    for _ in range(30):
        a = rng.randrange(10, len(times) - 200)
        gone |= set(times[a : a + 90])
    rows = [("free{}", t, true(t) + rng.gauss(0, 0.2)) for t in times if t not in gone]
    rows[500] = ("free{}", rows[500][1], 65535.0)
    got = {r.slot_ts: r.value for r in grid.missing_slots(points(spark, rows), catalog(spark)).collect()}
    assert set(got) == gone
    err = np.array([got[t] - true(t) for t in sorted(gone)])
    flat = np.sqrt(np.mean(err**2))
    assert np.median(np.abs(err)) < 0.35 and flat < 50
    held = sorted(t for _, t, _ in rows)
    line = np.interp(sorted(gone), held, [dict((t, v) for _, t, v in rows)[t] for t in held])
    assert np.median(np.abs(err)) < np.median(np.abs(line - [true(t) for t in sorted(gone)])) + 0.05


def test_grid_impossible_and_infinite_readings(spark):
    rows = [("g{}", 60 * k, 50.0) for k in range(50) if k not in (20, 21)] + [("g{}", 60 * 19 + 1, 9999.0), ("free{}", 0, math.inf), ("free{}", 180, 2.0)]
    got = {(r.series_id, r.slot_ts): r.value for r in grid.missing_slots(points(spark, rows), catalog(spark)).collect()}
    assert set(got) == {("g{}", 1200), ("g{}", 1260), ("free{}", 60), ("free{}", 120)}
    assert got[("g{}", 1200)] == pytest.approx(50, abs=0.5) and got[("free{}", 60)] == pytest.approx(2, abs=0.5)


def test_grid_empty(spark):
    assert grid.regular_grid(points(spark, []), catalog(spark)).count() == 0
    assert grid.missing_slots(points(spark, DIRT), catalog(spark)).count() == 0


# ---- implausible readings
def noisy(n, seed=2, phi=0.5, sd=1.0, level=50.0):
    rng = np.random.default_rng(seed)
    u = np.zeros(n)
    for i in range(1, n):
        u[i] = phi * u[i - 1] + rng.normal(0, sd)
    return np.round(level + u, 3)


def flagged(spark, series):
    rows = [(s, int(t), float(v)) for s, tv in series.items() for t, v in tv]
    got = spikes.implausible(points(spark, rows + DIRT), catalog(spark)).collect()
    return {(r.series_id, r.ts, r.reason) for r in got}


def test_spikes_stuck_and_limits(spark):
    n = 3000
    v = noisy(n)
    want = set()
    for at, size in ((100, 25), (511, -20), (512, 22), (1024, 30), (1500, 20), (1501, 21), (1502, 20)):
        v[at] += size
        want.add(("g{s}", at * 60, "spike"))
    v[2000:2030] = v[2000]
    v[1530:1550] = v[1530]  # across a block border
    want |= {("g{s}", i * 60, "stuck") for i in (*range(2000, 2030), *range(1530, 1550))}
    v[700], v[701] = -3.0, 120.0
    want |= {("g{s}", 700 * 60, "limit"), ("g{s}", 701 * 60, "limit")}
    v[2500:] += 12  # a lasting change is no case
    slow = np.round(50 + 20 * np.sin(np.arange(n) / 200) + noisy(n, 3, level=0.0, sd=0.3), 3)
    series = {"g{s}": list(zip(np.arange(n) * 60, v)), "g{slow}": list(zip(np.arange(n) * 60, slow)),
              "g{flat}": [(i * 60, 21.0 if i < 60 else 22.0) for i in range(120)],
              "g{few}": [(0, 1.0), (60, 90.0), (120, 101.0)]}
    assert flagged(spark, series) == want | {("g{few}", 120, "limit")}


def test_stuck_run_over_many_sparse_blocks(spark):
    """One reading per block: the stretch is seen although each block holds one reading of it."""
    n = 60
    v = noisy(n, 4)
    v[20:33] = 49.5
    v[40:51] = 48.5  # eleven only
    got = flagged(spark, {"free{}": [(i * 60 * spikes.BLOCK_READINGS, x) for i, x in enumerate(v)]})
    assert got == {("free{}", i * 60 * spikes.BLOCK_READINGS, "stuck") for i in range(20, 33)}


def test_corrections_do_not_end_a_stretch(spark):
    v = noisy(200, 6)
    v[50:70] = 51.25
    tv = [(i * 60, x) for i, x in enumerate(v)] + [(60 * 60, 51.27), (60 * 60, 51.25), (61 * 60, 51.2)]
    assert flagged(spark, {"free{}": tv}) == {("free{}", i * 60, "stuck") for i in range(50, 70)}


def test_infinite_and_odd(spark):
    v = noisy(200, 7)
    v[77] = math.inf
    got = flagged(spark, {"free{}": [(i * 60, x) for i, x in enumerate(v)], "g{i}": [(0, math.inf)], "odd{}": [(0, 4.0), (9, 6.0)]})
    assert got == {("free{}", 77 * 60, "spike"), ("g{i}", 0, "limit"), ("odd{}", 9, "limit")}


def test_implausible_empty(spark):
    assert spikes.implausible(points(spark, []), catalog(spark)).count() == 0


def test_blocks_find_what_the_uncut_series_shows(spark):
    n = 2600
    v = noisy(n, 9, phi=0.7)
    rng = np.random.default_rng(1)
    for at in rng.choice(np.arange(20, n - 20, 12), 60, replace=False):
        v[at] += rng.choice([-1, 1]) * rng.uniform(18, 60)
    v = np.clip(v, 0.1, 99)
    got = {t for _, t, r in flagged(spark, {"g{}": [(i * 60, x) for i, x in enumerate(v)]}) if r == "spike"}
    uncut = {int(i) * 60 for i in np.flatnonzero(spikes.outliers(v, 0.7, spikes.scatter(v)))}
    assert len(got ^ uncut) <= 1 and len(got) >= 55


def test_numbered(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3).withColumn("o", F.col("id") * 7 - 500)
    for r in numbered(df, ["k"], "o", 64).collect():
        assert r.rn == r.id // 3 + 1


def test_intervals_of_no_length(spark):
    cat = spark.createDataFrame([("g", "gauge", "u", 0, 0.0, 100.0, 1.0), ("free", "gauge", "u", -5, None, None, 1.0)], CATALOG)
    rows = [("g{}", 5, 101.0), ("g{}", 6, 1.0), ("free{}", 5, 1.0)]
    assert [r.ts for r in spikes.implausible(points(spark, rows), cat).collect()] == [5]
    assert grid.regular_grid(points(spark, rows), cat).count() == 0


def test_tables_without_metrics(spark):
    none = catalog(spark).limit(0)
    rows = [("g{}", 5, 101.0), ("d{}", 6, 1.0)]
    assert spikes.implausible(points(spark, rows), none).count() == 0
    assert grid.regular_grid(points(spark, rows), none).count() == 0
    assert trailing.activity(points(spark, rows), none).count() == 0


def test_a_spike_leaves_the_level_by_more_than_ten_scatters():
    rng = np.random.default_rng(5)
    y = rng.normal(50, 1, 400)
    for off, found in ((10.5, True), (9.5, False)):
        bad = y.copy()
        bad[200] = spikes.running_median(y)[200] + off * spikes.scatter(y)
        assert bool(spikes.outliers(bad, 0.0, spikes.scatter(y))[200]) is found, off


def test_spikes_of_a_gauge_that_mostly_repeats():
    rng = np.random.default_rng(6)
    y = 20 + np.where(rng.random(400) < 0.15, rng.choice([-1.0, 1.0], 400), 0.0)
    assert np.median(np.abs(np.diff(y))) == 0
    y[[90, 250, 251]] = [60.0, -30.0, -31.0]
    assert np.flatnonzero(spikes.outliers(y, 0.0, spikes.scatter(y))).tolist() == [90, 250, 251]
    assert spikes.scatter(np.full(50, 3.0)) == 0


def autoregressive(n, phi, seed):
    rng = np.random.default_rng(seed)
    u = np.zeros(n)
    for i in range(1, n):
        u[i] = phi * u[i - 1] + rng.normal()
    return u


def test_the_autoregression_decides():
    """Spikes of thirteen scatters in a strongly correlated series: with the fitted coefficient they are seen against
    what their neighbours let expect; without one, wandering hides some of them from a level of the readings around."""
    n, at = 6000, np.arange(40, 5960, 37)
    y = 100 + autoregressive(n, 0.95, 3)
    usual = spikes.scatter(y)
    y[at] += np.random.default_rng(4).choice([-1, 1], len(at)) * 13 * usual
    fitted, none = (np.flatnonzero(spikes.outliers(y, phi, usual)).tolist() for phi in (0.95, 0.0))
    assert fitted == at.tolist()
    assert len(none) < len(at) - 10


def test_lasting_shifts_and_plateaus_are_no_spikes():
    rng = np.random.default_rng(8)
    for length in (6, 8, 11, 15, 40):
        y = rng.normal(50, 1, 600)
        y[300 : 300 + length] += 30
        assert not spikes.outliers(y, 0.2, 1.0).any(), length
    for length in (1, 2, 3, 4, 5):
        y = rng.normal(50, 1, 600)
        y[300 : 300 + length] += 30
        assert np.flatnonzero(spikes.outliers(y, 0.2, 1.0)).tolist() == list(range(300, 300 + length)), length
    y = rng.normal(50, 1, 600)
    y[300:] += 30
    y[303] += 40
    assert np.flatnonzero(spikes.outliers(y, 0.2, 1.0)).tolist() == [303]
    many = rng.normal(50, 1, 3000)
    many[10:2990:9] += 25
    assert len(np.flatnonzero(spikes.outliers(many, 0.1, spikes.scatter(many)))) == len(range(10, 2990, 9))


def test_blocks_are_bounded_by_readings(spark):
    """300,000 readings in one minute of a gauge of one minute, and 50,000 copies of one reading."""
    rng = np.random.default_rng(2)
    hot = spark.range(300_000).select(
        F.lit("x").alias("metric"), F.lit("free{hot}").alias("series_id"), (F.col("id") % 60).alias("ts"),
        (F.hash("id") / 1e9 + 50).alias("value"), F.col("id").alias("seq"),
    )
    copies = spark.range(50_000).select(
        F.lit("x").alias("metric"), F.lit("free{copies}").alias("series_id"), F.lit(600).cast("long").alias("ts"),
        F.lit(50.5).alias("value"), (F.col("id") + 1_000_000).alias("seq"),
    )
    around = [("x", "free{copies}", 60 * i, float(v), 2_000_000 + i) for i, v in enumerate(np.round(rng.normal(50, 1, 40), 3)) if i != 10]
    around[30] = ("x", "free{copies}", around[30][2], 90.0, 3_000_000)
    p = hot.unionByName(copies).unionByName(spark.createDataFrame(around, "metric string, series_id string, ts long, value double, seq long"))
    blocks = spikes.reading_blocks(p, catalog(spark))
    sizes = blocks.select(F.max(F.size("rs")).alias("most"), F.sum(F.size("rs")).alias("n"), F.count(F.lit(1)).alias("blocks")).first()
    assert sizes.most <= spikes.BLOCK_READINGS and sizes.blocks >= 300_000 / spikes.BLOCK_READINGS
    assert 300_040 <= sizes.n < 300_040 + 20 or sizes.n == 300_040 - (300_000 - hot.select("ts", "value").distinct().count())
    got = [r.ts for r in spikes.implausible(p, catalog(spark)).where("series_id = 'free{copies}'").collect()]
    assert got == [around[30][2]]


def test_times_far_out_of_any_calendar(spark):
    far = 9 * 10**18
    rows = [("d{h=a}", 86400 * d, 1.0) for d in range(40)] + [("d{h=a}", far, 5.0), ("d{h=a}", -far, 7.0), ("d{h=b}", 5, 1.0)]
    got = {(r.series_id, r.day_no): (r.n_7, r.sum_30) for r in trailing.activity(points(spark, rows), catalog(spark)).collect()}
    # 31 days after the first reading, 40 days and 30 after them, the last day
    assert len(got) == 31 + 70 + 1 + 1
    assert got["d{h=a}", 39] == (7, 30.0) and got["d{h=a}", 69] == (0, 0.0) and got["d{h=a}", far // 86400] == (1, 5.0)
    marks = {(r.day_no, r.mark) for r in trailing.activity_marks(points(spark, rows), catalog(spark)).collect()}
    # two readings of the long-lived series lie far from others, so every day of the forty is past its 30th
    assert {d for d, m in marks if m == "quiet"} >= set(range(46, 69)) and (far // 86400, "surge") in marks


def test_marks_need_no_empty_days(spark):
    """Gaps of more than 30 days are cut for the marks and filled for the report; both tell the same."""
    rng = random.Random(11)
    rows = [("d{h=%d}" % rng.randrange(3), (rng.choice([0, 0, 100, 131, 500]) + rng.randrange(35)) * 86400, float(rng.randrange(9))) for _ in range(150)]
    got = {tuple(r) for r in trailing.activity_marks(points(spark, rows), catalog(spark)).collect()}
    first = {}
    for s, t, _ in rows:
        first[s] = min(first.get(s, 10**9), t // 86400)
    want = set()
    for (s, d), (n7, s7, n30, s30) in brute_days(rows).items():
        if d >= first[s] + 29 and n7 == 0 and n30 > 0:
            want.add((s, d, "quiet"))
        elif d >= first[s] + 29 and s30 > 0 and s7 * 30 > s30 * 17.5:
            want.add((s, d, "surge"))
    assert got == want and len(want) > 50


def test_grid_beats_straight_lines_on_noisy_series(spark):
    """Readings held out in runs: the ends of a gap are read from several readings, a straight line from one."""
    rng = random.Random(4)
    rows, held = [], {}
    for h in range(6):
        v = noisy(1600, 20 + h, phi=0.3, sd=1.0)
        gone = {k for a in range(60, 1500, 90) for k in range(a, a + 24)}
        for k, x in enumerate(v.tolist()):
            if k in gone:
                held["free{%d}" % h, 60 * k] = x
            else:
                rows.append(("free{%d}" % h, 60 * k + rng.randrange(60), x))
    got = {(r.series_id, r.slot_ts): r.value for r in grid.missing_slots(points(spark, rows), catalog(spark)).collect()}
    assert set(got) == set(held)
    line = {}
    for s in {s for s, _, _ in rows}:
        t, v = zip(*sorted((t // 60 * 60, x) for q, t, x in rows if q == s))
        line |= {(s, k): float(np.interp(k, t, v)) for q, k in held if q == s}
    error = lambda made: np.median([abs(made[k] - held[k]) for k in held])
    assert error(got) < 0.93 * error(line)


def test_grid_reads_its_points_once(spark):
    """The ends, the equations and the join of the blocks share one shuffle."""
    made = grid.missing_slots(points(spark, [("g{a}", 60 * i, 1.0) for i in range(0, 50, 3)]), catalog(spark))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("Initial Plan")]
    assert final.count("partial_max_by") == 1 and final.count("ReusedExchange") >= 2


def test_gauges_constant_by_nature_are_not_stuck(spark):
    rows = {"free{set}": [(60 * i, 21.0 if i < 70 else 22.0) for i in range(142)]}
    assert flagged(spark, rows) == set()
