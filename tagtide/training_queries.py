"""Queries of the training-data operators in the core, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.operators.grid import missing_slots, regular_grid
from tagtide.operators.spikes import implausible
from tagtide.operators.trailing import activity, activity_marks
from tagtide.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def p3_found(spark, d):
    return activity_marks(table(spark, d, "points"), table(spark, d, "metric_catalog"))


def p3_trailing(spark, d):
    """Every delta series and day."""
    made = activity(table(spark, d, "points"), table(spark, d, "metric_catalog")).drop("first_day")
    doubles = ["sum_day", "sum_7", "avg_7", "sum_30", "avg_30"]
    return made.withColumns({c: F.round(c, 6) for c in doubles})


DAYS_SQL = """WITH r AS (SELECT DISTINCT series_id, ts, value FROM points WHERE series_id IS NOT NULL AND ts IS NOT NULL
  AND value IS NOT NULL AND NOT isnan(value)
  AND split_part(series_id, '{', 1) IN (SELECT metric FROM metric_catalog WHERE kind = 'delta')),
 day AS (SELECT series_id, CAST(floor(ts / 86400.0) AS BIGINT) AS day_no, count(*) AS n, sum(value) AS s FROM r GROUP BY ALL),
 span AS (SELECT series_id, min(day_no) AS a, max(day_no) AS b FROM day GROUP BY series_id),
 dense AS (SELECT series_id, a, unnest(generate_series(a, b)) AS day_no FROM span),
 full_days AS (SELECT d.series_id, d.a, d.day_no, coalesce(y.n, 0) AS n, coalesce(y.s, 0.0) AS s
  FROM dense d LEFT JOIN day y ON d.series_id = y.series_id AND d.day_no = y.day_no),
 w AS (SELECT *, CAST(sum(n) OVER w7 AS BIGINT) AS n_7, sum(s) OVER w7 AS sum_7, CAST(sum(n) OVER w30 AS BIGINT) AS n_30,
   sum(s) OVER w30 AS sum_30
  FROM full_days WINDOW w7 AS (PARTITION BY series_id ORDER BY day_no ROWS 6 PRECEDING),
   w30 AS (PARTITION BY series_id ORDER BY day_no ROWS 29 PRECEDING))"""
QUERIES["p3_found"] = p3_found
SQL["p3_found"] = (
    DAYS_SQL
    + """ SELECT series_id, day_no, CASE WHEN n_7 = 0 AND n_30 > 0 THEN 'quiet' ELSE 'surge' END AS mark FROM w
 WHERE day_no >= a + 29 AND ((n_7 = 0 AND n_30 > 0) OR (sum_30 > 0 AND sum_7 * 30 > sum_30 * 17.5))"""
)
QUERIES["p3_trailing"] = p3_trailing
SQL["p3_trailing"] = (
    DAYS_SQL
    + """ SELECT series_id, day_no, n AS n_day, round(s, 6) AS sum_day, n_7, round(sum_7, 6) AS sum_7,
 round(sum_7 / 7, 6) AS avg_7, n_30, round(sum_30, 6) AS sum_30, round(sum_30 / 30, 6) AS avg_30 FROM w"""
)


# ---- 2: regular grid
def p2_found(spark, d):
    made = missing_slots(table(spark, d, "points"), table(spark, d, "metric_catalog"))
    return made.select("series_id", "slot_ts")


def p2_grid(spark, d):
    """Every slot; the estimates of missing ones come from a fitted model, so SQL gives none for this query."""
    return regular_grid(table(spark, d, "points"), table(spark, d, "metric_catalog"))


QUERIES["p2_found"] = p2_found
SQL["p2_found"] = """WITH r AS (SELECT DISTINCT series_id, ts, c.interval_s FROM points p JOIN metric_catalog c
  ON split_part(p.series_id, '{', 1) = c.metric WHERE c.kind = 'gauge' AND series_id IS NOT NULL AND ts IS NOT NULL
  AND value IS NOT NULL AND NOT isnan(value)),
 s AS (SELECT DISTINCT series_id, interval_s, CAST(floor(ts / CAST(interval_s AS DOUBLE)) AS BIGINT) AS slot FROM r),
 g AS (SELECT *, lead(slot) OVER (PARTITION BY series_id ORDER BY slot) AS nxt FROM s),
 m AS (SELECT series_id, interval_s, unnest(generate_series(slot + 1, nxt - 1)) AS slot FROM g
  WHERE nxt - slot > 1 AND (nxt - slot) * interval_s <= 604800)
 SELECT series_id, slot * interval_s AS slot_ts FROM m"""
QUERIES["p2_grid"] = p2_grid


def p2_observed(spark, d):
    """The slots of the grid that hold a reading: the latest one."""
    made = regular_grid(table(spark, d, "points"), table(spark, d, "metric_catalog"))
    return made.where(~F.col("missing")).select("series_id", "slot_ts", "value")


QUERIES["p2_observed"] = p2_observed
SQL["p2_observed"] = """SELECT series_id, slot * interval_s AS slot_ts, value FROM (SELECT series_id, c.interval_s,
  CAST(floor(ts / CAST(interval_s AS DOUBLE)) AS BIGINT) AS slot, arg_max(value, (ts, seq)) AS value
  FROM points p JOIN metric_catalog c ON split_part(p.series_id, '{', 1) = c.metric WHERE c.kind = 'gauge'
  AND series_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)"""


# ---- 4: implausible readings
def p4_found(spark, d):
    return implausible(table(spark, d, "points"), table(spark, d, "metric_catalog")).select("series_id", "ts").distinct()


def p4_reasons(spark, d):
    """Every implausible reading with its value and reason."""
    return implausible(table(spark, d, "points"), table(spark, d, "metric_catalog"))


QUERIES |= {"p4_found": p4_found, "p4_reasons": p4_reasons}
