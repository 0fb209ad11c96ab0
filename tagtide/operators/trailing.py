"""Totals and averages over trailing days, days without activity included.

Readings are reduced to one row per series and day before anything is ordered, so a series of any number of
readings has at most one row per calendar day. Sums of 2, 4, 8 and 16 days follow by doubling: each adds the
sum half as long that ends where the newer half begins. Any window is a chain of such blocks, largest first
(7 = 4 + 2 + 1, 30 = 16 + 8 + 4 + 2); all shifts run over one partitioning and one sort.

Defined cases: rows with a null series, time or value and NaN values are no readings; copies (same series,
time, value) count once; negative values add as they are; before the first day a window holds what there is;
an empty table gives no rows; other columns are ignored. Sums of infinite values follow IEEE arithmetic. Where stray
times lie more than LONGEST_GAP days apart, the days between are given as far as a window of the longest length reaches
back to activity; the rest, in which every window is empty, has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.functions.columns import DAY_S
from tagtide.operators.readings import KEY, of_kind, series_key, series_names

#: Longest time without readings whose days are all given: a hundred years.
LONGEST_GAP = 36_525


def daily(readings: DataFrame) -> DataFrame:
    """(k1, k2, day_no, day_n, day_sum) from rows of series_id, ts, value."""
    keyed = readings.select(*series_key(F.col("series_id")), "ts", "value").distinct()
    day = F.floor(F.col("ts") / F.lit(DAY_S)).cast("bigint")
    return keyed.groupBy(*KEY, day.alias("day_no")).agg(
        F.count(F.lit(1)).alias("day_n"), F.sum("value").alias("day_sum")
    )


def dense_days(days: DataFrame, reach: int = 366, longest_gap: int = LONGEST_GAP) -> DataFrame:
    """Every day between a series' first and last; missing ones hold 0. The gap after a day is filled from the row
    itself, so no calendar is joined. Of gaps longer than ``longest_gap`` the first ``reach`` days are filled, and
    another segment begins after them: windows of at most ``reach`` days are empty from there on."""
    order = Window.partitionBy(*KEY).orderBy("day_no")
    until = F.lead("day_no").over(order) - F.col("day_no")
    since = F.col("day_no") - F.lag("day_no").over(order)
    head = F.when(F.coalesce(since > longest_gap, F.lit(True)), F.col("day_no"))
    filled = F.when(until <= longest_gap, until - 1).when(until.isNotNull(), F.lit(reach).cast("bigint")).otherwise(0)
    return (
        days.withColumns({"filled_": filled, "head_": head})
        .withColumn("segment", F.max("head_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("first_day", F.min("day_no").over(Window.partitionBy(*KEY)))
        .withColumn("after_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("filled_"))))
        .select(
            *KEY,
            "segment",
            (F.col("day_no") + F.col("after_")).alias("day_no"),
            "first_day",
            F.when(F.col("after_") == 0, F.col("day_n")).otherwise(0).alias("n1"),
            F.when(F.col("after_") == 0, F.col("day_sum")).otherwise(0.0).alias("s1"),
        )
    )


def powers(window: int) -> list[int]:
    """The powers of two that make up a window, largest first."""
    return [1 << b for b in range(window.bit_length() - 1, -1, -1) if window >> b & 1]


def trailing(days: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Columns n_<w>, sum_<w> for each window of days ending with the row's day."""
    if not windows or min(windows) < 1:
        raise ValueError("windows must be positive numbers of days")
    order = Window.partitionBy(*KEY, "segment").orderBy("day_no")

    def back(name: str, shift: int) -> Column:
        if not shift:
            return F.col(name)
        return F.lag(name, shift, 0 if name[0] == "n" else 0.0).over(order)

    top = max(windows).bit_length() - 1
    for b in range(top):
        half, full = 1 << b, 1 << (b + 1)
        days = days.withColumns({f"{c}{full}": F.col(f"{c}{half}") + back(f"{c}{half}", half) for c in "ns"})
    made: dict[str, Column] = {}
    for w in windows:
        for c, name in (("n", f"n_{w}"), ("s", f"sum_{w}")):
            shift, total = 0, None
            for p in powers(w):
                part = back(f"{c}{p}", shift)
                total = part if total is None else total + part
                shift += p
            made[name] = total
    return days.withColumns(made).drop(*[f"{c}{1 << b}" for b in range(1, top + 1) for c in "ns"])


def activity(points: DataFrame, catalog: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per delta series and calendar day: readings and totals of the day and of each trailing window, with
    averages per day of the window."""
    made = trailing(dense_days(daily(of_kind(points, catalog, "delta")), max(windows)), windows)
    made = made.withColumns({f"avg_{w}": F.col(f"sum_{w}") / w for w in windows})
    names = series_names(points)
    return made.join(names, KEY).select(
        "series_id", "day_no", "first_day", F.col("n1").alias("n_day"), F.col("s1").alias("sum_day"),
        *[f"{c}_{w}" for w in windows for c in ("n", "sum", "avg")],
    )


def activity_marks(points: DataFrame, catalog: DataFrame, surge: float = 2.5) -> DataFrame:
    """Days on which activity fell silent (``quiet``) or rose (``surge``), from the 30th day of a series on.
    The comparison of averages is made on cross-multiplied totals, exact for whole numbers. Days more than 30 after any
    activity have no mark and are never made."""
    made = trailing(dense_days(daily(of_kind(points, catalog, "delta")), 30, 30), (7, 30))
    quiet = (F.col("n_7") == 0) & (F.col("n_30") > 0)
    high = (F.col("sum_30") > 0) & (F.col("sum_7") * 30 > F.col("sum_30") * (7 * surge))
    mark = F.when(quiet, "quiet").when(high, "surge")
    cases = (
        made.where(F.col("day_no") >= F.col("first_day") + 29)
        .withColumn("mark", mark)
        .where(F.col("mark").isNotNull())
        .select(*KEY, "day_no", "mark")
    )
    return cases.join(series_names(points), KEY).select("series_id", "day_no", "mark")
