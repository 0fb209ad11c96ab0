"""Irregular readings onto the regular grid of each series, gaps filled by a seasonal model.

One value per slot is kept (the latest reading, of equal times the one written last), so repeated and corrected
readings need no separate pass. Slots are gathered into blocks of consecutive slots, at most BLOCK_SLOTS of one
series, so no task ever holds a whole series. Per series a harmonic regression (level, trend, two harmonics of
the day) is fitted from normal equations, summed with partial aggregation; only one row of sums per series is
solved, in batches. A missing slot gets the model's value plus the residuals at both ends of the gap, bridged
linearly in time; the residual of an end is the median over the END_SLOTS slots next to it that hold a reading, since
that of a single one is mostly noise.

The blocks are aggregated by one shuffle of slots and one of blocks. The latter serves all that reads them: the ends
of blocks, the normal equations and the join of blocks with their models; nothing is written in between.

Defined cases: rows with a null series, time or value and NaN are no readings; readings outside the metric's
limits or infinite stand in the grid as they are but neither shape the fit nor bridge a gap (then the other
end's residual is used, or none); of readings with one time and no write order that with the greater value
is the latest; a gap whose ends lie more than ``off_after`` seconds apart is off time and
gives no rows; a series of one slot gives one row; metrics without an interval give none; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.operators.readings import KEY, of_kind, series_key, series_names

BLOCK_SLOTS = 512
OFF_AFTER_S = 7 * 86_400
FEATURES = ("one", "t", "c1", "s1", "c2", "s2")
COEFFICIENTS = [f"b_{f}" for f in FEATURES]
RIDGE = 1e-3
#: Slots on each side of a gap whose readings give the residual there.
END_SLOTS = 8


def features(start_s: Column) -> dict[str, Column]:
    """Level, days since the epoch, first and second harmonic of the day, of a slot's start."""
    angle = F.pmod(start_s, F.lit(86_400)) * (2 * math.pi / 86_400)
    return {
        "one": F.lit(1.0),
        "t": start_s / F.lit(86_400.0),
        "c1": F.cos(angle),
        "s1": F.sin(angle),
        "c2": F.cos(angle * 2),
        "s2": F.sin(angle * 2),
    }


def slot_blocks(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """(k1, k2, interval_s, block, slots) with slots an ordered array of (slot, value, ok), one per slot that
    holds a reading."""
    rows = of_kind(points, catalog, "gauge").where(F.col("interval_s") > 0)
    slot = F.floor((F.col("ts") - F.pmod("ts", "interval_s")) / F.col("interval_s")).cast("bigint")
    fits = (
        F.coalesce(F.col("value") >= F.col("low_limit"), F.lit(True))
        & F.coalesce(F.col("value") <= F.col("high_limit"), F.lit(True))
        & (F.abs("value") < float("inf"))
    )
    # an order key of fixed width, as in downsampling, costs more here than the sort it saves: slots hardly combine
    latest = F.max_by(F.struct("value", fits.alias("ok")), F.struct("ts", *(["seq"] if "seq" in rows.columns else []), "value"))
    slots = (
        rows.groupBy(*series_key(F.col("series_id")), "interval_s", slot.alias("slot"))
        .agg(latest.alias("v"))
        .select(*KEY, "interval_s", "slot", "v.*")
    )
    return (
        slots.withColumn("block", F.floor(F.col("slot") / BLOCK_SLOTS).cast("bigint"))
        .where(F.col("block").isNotNull())  # said here, so the join that implies it reads the same shuffle
        .groupBy(*KEY, "interval_s", "block")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "value", "ok"))).alias("slots"))
    )


def normal_equations(blocks: DataFrame) -> DataFrame:
    """One row of sums per series: products of features, and of features with the value. Values are clipped to
    three quartile ranges around the quartiles of their block, which keeps single spikes out of the fit."""
    usable = F.filter("slots", lambda s: s["ok"])
    ranked = F.array_sort(F.transform(usable, lambda s: s["value"]))
    cut = blocks.select(*KEY, "interval_s", usable.alias("slots"), ranked.alias("ranked"))
    n = F.size("ranked")
    at = lambda q: F.try_element_at("ranked", (F.floor((n - 1) * q) + 1).cast("int"))
    fenced = cut.where(n > 0).select(*KEY, "interval_s", "slots", at(0.25).alias("q1"), at(0.75).alias("q3"))
    wide = fenced.select(*KEY, "interval_s", "slots", (F.col("q1") - 3 * (F.col("q3") - F.col("q1"))).alias("lo"),
                         (F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).alias("hi"))
    flat = wide.select(*KEY, "interval_s", "lo", "hi", F.inline("slots"))
    made = flat.select(
        *KEY,
        F.greatest("lo", F.least("hi", "value")).alias("y"),
        *[c.alias(name) for name, c in features(F.col("slot") * F.col("interval_s")).items()],
    )
    sums = [
        F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(FEATURES) for b in FEATURES[i:]
    ] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in FEATURES]
    return made.groupBy(*KEY).agg(*sums)


def _solve(batches):
    for batch in batches:
        if not len(batch):
            continue
        n, p = len(batch), len(FEATURES)
        gram, right = np.empty((n, p, p)), np.empty((n, p))
        for i, a in enumerate(FEATURES):
            for b in FEATURES[i:]:
                j = FEATURES.index(b)
                gram[:, i, j] = gram[:, j, i] = batch[f"{a}_{b}"]
            right[:, i] = batch[f"{a}_y"]
        count = gram[:, 0, 0]
        mean, level = gram[:, 0, 1:] / count[:, None], right[:, 0] / count
        cov = gram[:, 1:, 1:] / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
        own = right[:, 1:] / count[:, None] - mean * level[:, None]
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", cov), 1e-9))
        cov = cov / scale[:, :, None] / scale[:, None, :] + (RIDGE + 1 / count[:, None, None]) * np.eye(p - 1)
        slope = np.linalg.solve(cov, (own / scale)[:, :, None])[:, :, 0] / scale
        made = np.column_stack([level - (slope * mean).sum(1), slope])
        made = np.where(np.isfinite(made).all(1)[:, None], made, 0.0)
        yield pd.concat([batch[KEY], pd.DataFrame(made, columns=COEFFICIENTS, index=batch.index)], axis=1)


def seasonal_models(blocks: DataFrame) -> DataFrame:
    """(k1, k2, b_one, b_t, b_c1, b_s1, b_c2, b_s2) per series. Columns are centred and scaled before solving and
    carry a small ridge that grows for short series, so short or constant series stay solvable."""
    schema = ", ".join(["k1 bigint", "k2 bigint", *[f"{c} double" for c in COEFFICIENTS]])
    return normal_equations(blocks).mapInPandas(_solve, schema)


def predicted(start_s: Column) -> Column:
    total = F.lit(0.0)
    for name, c in features(start_s).items():
        total = total + F.coalesce(F.col(f"b_{name}"), F.lit(0.0)) * c
    return total


def modelled(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """Blocks with their model and name, the last slots of the block before and the first of the one after. The window
    over a series sees one row of bounded size per block."""
    blocks = slot_blocks(points, catalog)
    order = Window.partitionBy(*KEY).orderBy("block")
    tail = F.slice("slots", F.greatest(F.lit(1), F.size("slots") - END_SLOTS + 1), F.lit(END_SLOTS))
    ends = blocks.select(*KEY, "interval_s", "block", F.slice("slots", 1, END_SLOTS).alias("head"), tail.alias("tail"))
    none = F.array().cast(ends.schema["head"].dataType)
    context = (
        ends.select(
            *KEY, "interval_s", "block",
            F.coalesce(F.lag("tail").over(order), none).alias("before"), F.coalesce(F.lead("head").over(order), none).alias("after"),
        )
        .join(seasonal_models(blocks), KEY, "left")
        .join(series_names(points), KEY)
    )
    return blocks.join(context, [*KEY, "interval_s", "block"])


def stretches(rows: DataFrame, off_after: int, observed: bool) -> DataFrame:
    """One row per gap that begins in a block: the slots a and b at its ends, and those next to them on both sides.
    With ``observed`` each slot that holds a reading is a row too, lying alone between a and b, its value in seen."""
    rows = rows.withColumn("far", F.concat("slots", "after"))
    far = F.col("far")
    near = lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - END_SLOTS + 1), F.lit(END_SLOTS))
    apart = lambda i: F.try_element_at(far, i + 1)["slot"] - F.element_at("slots", i)["slot"]
    starts = F.filter(
        F.sequence(F.lit(1), F.size("slots")),
        lambda i: F.coalesce((apart(i) > 1) & (apart(i) * F.col("interval_s") <= off_after), F.lit(False)),
    )

    def gap(i: Column) -> Column:
        first = near(F.concat("before", F.slice("slots", F.lit(1), i)))
        left = F.when(i >= END_SLOTS, F.slice("slots", i - (END_SLOTS - 1), F.lit(END_SLOTS))).otherwise(first)
        return F.struct(
            F.element_at("slots", i)["slot"].alias("a"), F.element_at(far, i + 1)["slot"].alias("b"), left.alias("left"),
            F.slice(far, i + 1, F.lit(END_SLOTS)).alias("right"), F.lit(None).cast("double").alias("seen"),
        )

    found = F.transform(starts, gap)
    if observed:
        none = F.slice("slots", 1, 0)
        alone = lambda s: F.struct(
            (s["slot"] - 1).alias("a"), (s["slot"] + 1).alias("b"), none.alias("left"), none.alias("right"),
            s["value"].alias("seen"),
        )
        found = F.concat(found, F.transform("slots", alone))
    return rows.select("series_id", "interval_s", *COEFFICIENTS, F.inline(found))


def _filled(rows: DataFrame, off_after: int, observed: bool) -> DataFrame:
    def residual(side: str) -> Column:
        """Median of the residuals of the usable slots; none, null."""
        usable = F.filter(side, lambda s: s["ok"])
        left = F.array_sort(F.transform(usable, lambda s: s["value"] - predicted(s["slot"] * F.col("interval_s"))))
        n = F.size(left)
        at = lambda k: F.try_element_at(left, F.greatest(k, F.lit(1)).cast("int"))
        return (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2

    ends = stretches(rows, off_after, observed).withColumn("r0", residual("left")).withColumn("r1", residual("right"))
    ends = ends.select(
        "series_id", "interval_s", *COEFFICIENTS, "a", "b", "seen",
        F.coalesce("r0", "r1", F.lit(0.0)).alias("r0"), F.coalesce("r1", "r0", F.lit(0.0)).alias("r1"),
    )
    flat = ends.withColumn("slot", F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)))
    share = (F.col("slot") - F.col("a")) / (F.col("b") - F.col("a"))
    start = F.col("slot") * F.col("interval_s")
    value = predicted(start) + F.col("r0") + (F.col("r1") - F.col("r0")) * share
    return flat.select(
        "series_id", start.alias("slot_ts"), F.coalesce("seen", value).alias("value"), F.col("seen").isNull().alias("missing")
    )


def regular_grid(points: DataFrame, catalog: DataFrame, off_after: int = OFF_AFTER_S) -> DataFrame:
    """(series_id, slot_ts, value, missing) for every slot of every gauge series; missing ones hold the estimate."""
    return _filled(modelled(points, catalog), off_after, True)


def missing_slots(points: DataFrame, catalog: DataFrame, off_after: int = OFF_AFTER_S) -> DataFrame:
    """The estimated rows of the grid alone, (series_id, slot_ts, value); every one carries a finite estimate."""
    made = _filled(modelled(points, catalog), off_after, False)
    return made.where(F.col("value").isNotNull() & ~F.isnan("value")).select("series_id", "slot_ts", "value")
