"""Implausible readings of gauge series: spikes, stuck stretches and values beyond the physical limits.

Readings are sorted over all tasks by (series, time, value) and cut into blocks of at most BLOCK_READINGS readings of
one series; copies lie side by side then and are dropped. The order has a salt of the write order behind it, so even
copies of one reading spread over tasks. Each block fits a robust autoregression of order one to its deviations from a
running median; sums of the blocks give one model per series (coefficient, scatter of successive differences, share of
unchanged neighbours). The model and the last and first readings of the blocks around go back to every block, so tests
at block borders see what an uncut series would show.

In a block readings beyond the limits are set aside. The residuals e[t] = u[t] - phi u[t-1] of the deviations u from the
level then show what happened: an additive outlier of size w over L readings leaves w, (L - 1) times (1 - phi) w and
-phi w in them, a lasting shift w and (1 - phi) w ever after. Both are estimated by least squares at every reading, for
all L up to FEW, and compared by their statistics against the scatter of the residuals. The strongest effects are taken
first: an outlier is flagged and replaced by what the model expects between its neighbours, a shift is taken out of
the level; then residuals are computed anew, until no effect larger than the bound is left. The bound is
SPIKE_SCATTERS times the usual scatter; each flagged reading must lie that far from what the model expects in its
place, in a row of at most FEW. A stretch of STUCK_RUN or more readings with one value is flagged as a whole in a
series most of whose other readings change.

No task holds more than one batch of blocks; the window over a series sees one row of bounded size per block.

Defined cases: rows with a null series, time or value and NaN are no readings; copies count once; infinite values
lie beyond a limit if the metric has one there, else they are spikes; readings of one time are taken in order of
value, and one that only corrects another does not end a stretch; a metric without limits has no limit cases; its
interval does not matter; series without scatter have no spikes; short series (under five readings) are only
tested against limits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.operators.blocks import written
from tagtide.operators.readings import KEY, of_kind, series_key, series_names

BLOCK_READINGS = 512
#: Readings of the neighbouring blocks that a block sees on each side, and how many blocks they may come from.
#: Every block holds at least one reading, so STUCK_RUN blocks always reach far enough for a stretch.
CONTEXT = 32
SPIKE_SCATTERS = 10.0
STUCK_RUN = 12
FEW = 5
WINDOW = 31
#: Readings over which a lasting shift is estimated, and least ratio of an effect's statistic to the residuals' scatter.
SHIFT_READINGS = 2 * FEW + 1
CRITICAL = 4.0
#: Parts into which copies of one reading may be spread.
SALTS = 4096
BLOCK = "k1 bigint, k2 bigint, block bigint, rs array<struct<ts:bigint,value:double,broken:boolean>>"


def _cut(batches):
    """Sorted rows to blocks. Copies of a reading in one task are dropped; block ids ascend in the order of the sort."""
    first = TaskContext.get().partitionId() << 32
    held: list[np.ndarray] | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(pair) for pair in zip(held, cols)]
        else:
            cols = held
        if cols is None or not len(cols[0]):
            continue
        k1, k2, ts, value, _ = cols
        fresh = np.ones(len(k1), bool)
        fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        keep = fresh.copy()
        keep[1:] |= (ts[1:] != ts[:-1]) | (value[1:] != value[:-1])
        k1, k2, ts, value, broken = cols = [c[keep] for c in cols]
        starts = np.flatnonzero(fresh[keep])
        place = np.arange(len(k1)) - np.repeat(starts, np.diff(np.append(starts, len(k1))))
        at = np.flatnonzero(place % BLOCK_READINGS == 0)
        # the last block may go on in the next batch
        end = len(k1) if batch is None else int(at[-1])
        at = at if batch is None else at[:-1]
        held = [c[end:] for c in cols]
        if not len(at):
            continue
        rs = pa.StructArray.from_arrays([pa.array(c[:end]) for c in (ts, value, broken)], ["ts", "value", "broken"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, end), pa.int32()), rs)
        ids = pa.array(first + np.arange(len(at)))
        first += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), ids, lists], ["k1", "k2", "block", "rs"])


def reading_blocks(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """(k1, k2, block, rs): at most BLOCK_READINGS distinct readings of a series in order of (ts, value), with a flag for
    broken limits. Blocks ascend along a series. Only copies that lie in different tasks are left, where a block
    begins with the last reading of the one before."""
    rows = of_kind(points, catalog, "gauge")
    broken = F.coalesce(F.col("value") < F.col("low_limit"), F.lit(False)) | F.coalesce(
        F.col("value") > F.col("high_limit"), F.lit(False)
    )
    salt = F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int") if "seq" in rows.columns else F.lit(0)
    placed = rows.select(
        *series_key(F.col("series_id")), "ts", (F.col("value") + 0.0).alias("value"), broken.alias("broken"), salt.alias("salt")
    ).repartitionByRange(*KEY, "ts", "value", "salt")
    ordered = placed.drop("salt").sortWithinPartitions(*KEY, "ts", "value")
    return ordered.mapInArrow(_cut, BLOCK)


def running_median(y: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Median of the window around each value; ends are reflected, short arrays have one median."""
    half = window // 2
    if len(y) <= half:
        return np.full(len(y), np.median(y))
    wide = np.pad(y, half, mode="reflect")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, window), axis=1)


def scatter(y: np.ndarray) -> float:
    """Robust standard deviation of successive differences, brought to that of single values. Where more than half of
    the readings repeat the one before, that of the differences that are not 0."""
    moves = np.abs(np.diff(y))
    usual = np.median(moves) if len(moves) else 0.0
    if usual == 0 and moves.any():
        usual = np.median(moves[moves > 0])
    return float(usual * 1.4826 / np.sqrt(2))


def long_runs(ts: np.ndarray, v: np.ndarray, least: int = STUCK_RUN) -> np.ndarray:
    """Flags of readings in stretches of one value. Of several readings of one time, one that goes on with the value
    before stands for all; the others neither end the stretch nor belong to it."""
    keep = np.ones(len(v), bool)
    for i in np.flatnonzero(ts[1:] == ts[:-1]) + 1:
        a = i - 1
        while a > 0 and not keep[a]:
            a -= 1
        b = a - 1
        while b > 0 and not keep[b]:
            b -= 1
        if ts[a] == ts[i] and b >= 0 and v[i] == v[b] != v[a]:
            keep[a] = False
        elif ts[a] == ts[i] and b >= 0 and v[a] == v[b] != v[i]:
            keep[i] = False
    at = np.flatnonzero(keep)
    flags = np.zeros(len(v), bool)
    w = v[at]
    if len(w):
        edges = np.concatenate([[0], np.flatnonzero(w[1:] != w[:-1]) + 1, [len(w)]])
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a >= least:
                flags[at[a:b]] = True
    return flags


MODEL_SUMS = ["n", "scatter_n", "sxx", "sxy", "pairs", "same", "stretches"]


def _block_sums(batches):
    """Sums of the robust autoregression of each stretch, weighted by the readings it stands for."""
    for batch in batches:
        out = []
        for k1, k2, own, ts, value, broken in zip(batch.k1, batch.k2, batch.own, batch.ts, batch.value, batch.broken):
            good = ~np.asarray(broken, bool) & np.isfinite(value)
            part = own / len(good)
            ts, y = np.asarray(ts)[good], np.asarray(value)[good]
            stuck = long_runs(ts, y)
            pairs = ~(stuck[1:] & stuck[:-1])
            ends = stuck & np.append((y[1:] != y[:-1]) | ~stuck[1:], True)[: len(y)]
            moves = (part * pairs.sum(), part * ((y[1:] == y[:-1]) & pairs).sum(), part * ends.sum())
            free = y[~stuck]
            if len(free) < 5:
                out.append((k1, k2, 0.0, 0.0, 0.0, 0.0, *moves))
                continue
            s = scatter(free)
            u = np.clip(free - running_median(free), -3 * s, 3 * s)
            n = part * len(free)
            out.append((k1, k2, n, s * n, part * float(u[:-1] @ u[:-1]), part * float(u[1:] @ u[:-1]), *moves))
        if out:
            yield pd.DataFrame(out, columns=[*KEY, *MODEL_SUMS])


def series_models(blocks: DataFrame, around: DataFrame) -> DataFrame:
    """(k1, k2, phi, usual, same_share) per series. A series that changes no more often outside its stretches of one
    value than it has stretches is constant by nature, its share is 1. Blocks of up to CONTEXT readings are seen with the readings around
    them, so sparse series have a model too."""
    long = blocks.where(F.size("rs") > CONTEXT).select(*KEY, F.size("rs").alias("own"), "rs")
    short = around.where(F.col("own") <= CONTEXT).select(*KEY, "own", F.concat("b", "head", "a").alias("rs"))
    fields = ", ".join(f"{c} double" for c in MODEL_SUMS)
    seen = long.unionByName(short).select(*KEY, "own", "rs.ts", "rs.value", "rs.broken")
    parts = seen.mapInPandas(_block_sums, f"k1 bigint, k2 bigint, {fields}")
    sums = parts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in MODEL_SUMS])
    phi = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0))))
    return sums.select(
        *KEY,
        phi.alias("phi"),
        F.coalesce(F.try_divide("scatter_n", "n"), F.lit(0.0)).alias("usual"),
        F.when(F.col("pairs") - F.col("same") > F.col("stretches"), F.try_divide("same", "pairs"))
        .otherwise(F.lit(1.0))
        .alias("same_share"),
    )


def bridged(u: np.ndarray, gone: np.ndarray, phi: float) -> np.ndarray:
    """Deviations with those that are gone replaced by what the autoregression expects between their neighbours."""
    out = u.copy()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        k, m = np.arange(1, b - a + 1), b - a + 1
        left = u[a - 1] if a else 0.0
        right = u[b] if b < len(u) else 0.0
        if not a or b == len(u):
            out[a:b] = phi**k * left + phi ** (m - k) * right
        else:
            from_left, from_right = phi**k * (1 - phi ** (2 * (m - k))), phi ** (m - k) * (1 - phi ** (2 * k))
            out[a:b] = (from_left * left + from_right * right) / (1 - phi ** (2 * m))
    return out


def effects(e: np.ndarray, phi: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, size, statistic) of the strongest effect that begins at each reading, from the residuals: an outlier of
    1 to FEW readings, or 0 for a lasting shift. Least squares on the pattern each effect leaves."""
    n = len(e)
    total = np.concatenate([[0.0], np.cumsum(e)])
    at = np.arange(n)
    upto = lambda length: total[np.minimum(at + length, n)] - total[np.minimum(at + 1, n)]
    fade = 1 - phi
    seen = np.minimum(n - at, SHIFT_READINGS)
    norm = 1 + (seen - 1) * fade * fade
    dot = e + fade * upto(SHIFT_READINGS)
    kind, size, stat = np.zeros(n, np.int64), dot / norm, np.abs(dot) / np.sqrt(norm)
    for length in range(1, FEW + 1):
        norm = 1 + (length - 1) * fade * fade + phi * phi
        after = np.zeros(n)
        after[: n - length] = e[length:]
        dot = e + fade * upto(length) - phi * after
        now = np.abs(dot) / np.sqrt(norm)
        better = (now > stat) & (at + length < n)
        kind[better], size[better], stat[better] = length, (dot / norm)[better], now[better]
    return kind, size, stat


def outliers(y: np.ndarray, phi: float, usual: float, limit: float = SPIKE_SCATTERS) -> np.ndarray:
    """Flags of additive outliers of a stretch of readings, told from level shifts by their effects on the residuals."""
    n = len(y)
    flags = np.zeros(n, bool)
    if n < 5 or not usual > 0:
        return flags
    y = np.where(np.isfinite(y), y, np.sign(y) * 1e300)
    local = scatter(y) if n >= 2 * WINDOW else usual
    bound = limit * max(local, 0.6 * usual)
    work, shifts, shifted = y.copy(), np.zeros(n), np.zeros(n, bool)
    while True:
        level = running_median(work)
        u = bridged(work - level, flags, phi)
        e = u.copy()
        e[1:] -= phi * u[:-1]
        kind, size, stat = effects(e, phi)
        noise = 1.4826 * np.median(np.abs(e))
        strong = np.flatnonzero((np.abs(size) > bound) & (stat > CRITICAL * noise))
        taken = []
        for t in strong[np.argsort(-stat[strong], kind="stable")].tolist():
            if any(abs(t - o) <= SHIFT_READINGS for o in taken):
                continue
            span = slice(t, t + kind[t])
            if flags[span].all() if kind[t] else shifted[t]:
                continue
            taken.append(t)
            if kind[t]:
                flags[span] = True
            else:
                shifted[t] = True
                shifts[t:] += size[t]
                work[t:] -= size[t]
        if not taken:
            break
        work = np.where(flags, level + bridged(u, flags, phi), work)
    expected = level + bridged(work - level, flags, phi) + shifts
    flags &= np.abs(y - expected) > bound
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a > FEW or b == n or a == 0:
            flags[a:b] = False
    return flags


def judge(ts, value, broken, phi: float, usual: float, same_share: float) -> np.ndarray:
    """0 plausible, 1 beyond limits, 2 spike, 3 stuck, for readings in order."""
    marks = np.where(broken, 1, 0)
    good = np.flatnonzero(~broken)
    y, t = value[good], ts[good]
    marks[good[outliers(y, phi, usual)]] = 2
    if same_share < 0.5:
        marks[good[long_runs(t, y)]] = 3
    return marks


REASONS = ("", "limit", "spike", "stuck")


def _flagged(batches):
    for batch in batches:
        out: dict[str, list] = {"series_id": [], "ts": [], "value": [], "reason": []}
        for r in batch.itertuples(index=False):
            own = np.repeat([False, True, False], [len(r.b_ts), len(r.ts), len(r.a_ts)])
            ts = np.concatenate([r.b_ts, r.ts, r.a_ts]).astype(np.int64)
            value = np.concatenate([r.b_value, r.value, r.a_value]).astype(float)
            broken = np.concatenate([r.b_broken, r.broken, r.a_broken]).astype(bool)
            once = np.ones(len(ts), bool)
            once[1:] = (ts[1:] != ts[:-1]) | (value[1:] != value[:-1])
            ts, value, broken, own = ts[once], value[once], broken[once], own[once]
            marks = judge(ts, value, broken, r.phi, r.usual, r.same_share)
            at = np.flatnonzero((marks > 0) & own)
            out["series_id"] += [r.series_id] * len(at)
            out["ts"] += ts[at].tolist()
            out["value"] += value[at].tolist()
            out["reason"] += [REASONS[m] for m in marks[at]]
        if out["ts"]:
            yield pd.DataFrame(out)


def contexts(blocks: DataFrame) -> DataFrame:
    """(k1, k2, block, own, head, b, a): size and first readings of a block, readings before and after it."""
    last = lambda rs: F.slice(rs, F.greatest(F.lit(1), F.size(rs) - CONTEXT + 1), F.lit(CONTEXT))
    order = Window.partitionBy(*KEY).orderBy("block")
    ends = blocks.select(
        *KEY, "block", F.size("rs").alias("own"), F.slice("rs", 1, CONTEXT).alias("head"), last("rs").alias("tail")
    )
    # a block of nothing but another copy of the reading before it does not count
    copy = (F.col("own") == 1) & F.col("head")[0].eqNullSafe(F.try_element_at(F.lag("tail").over(order), F.lit(-1)))
    ends = ends.withColumn("copy", copy).where(~F.col("copy"))
    before = F.flatten(F.collect_list("tail").over(order.rowsBetween(-STUCK_RUN, -1)))
    after = F.flatten(F.collect_list("head").over(order.rowsBetween(1, STUCK_RUN)))
    wide = ends.select(*KEY, "block", "own", "head", before.alias("b"), F.slice(after, 1, CONTEXT).alias("a"))
    return wide.withColumn("b", last("b"))


def implausible(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """(series_id, ts, value, reason) of implausible readings; reason is limit, spike or stuck."""
    blocks = written(reading_blocks(points, catalog))
    around = contexts(blocks)
    context = (
        around.select(*KEY, "block", "b", "a").join(series_models(blocks, around), KEY).join(series_names(points), KEY)
    )
    joined = blocks.join(context, [*KEY, "block"]).select(
        "series_id", "phi", "usual", "same_share",
        *[F.col(f"{src}.{f}").alias(f"{name}{f}") for src, name in (("b", "b_"), ("rs", ""), ("a", "a_"))
          for f in ("ts", "value", "broken")],
    )
    return joined.mapInPandas(_flagged, "series_id string, ts bigint, value double, reason string")
