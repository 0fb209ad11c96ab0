"""Queries of the llm operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.llm.bpe import token_ids
from tagtide.llm.mixing import mixture
from tagtide.llm.mojibake import garbled_texts
from tagtide.llm.percentiles import named_percentiles, outlying_series
from tagtide.llm.term_frequency import term_frequencies
from tagtide.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


# ---- 1: terms
def p1_found(spark, d):
    return term_frequencies(table(spark, d, "points")).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p1_terms(spark, d):
    """Every term with its counts."""
    return term_frequencies(table(spark, d, "points"))


TERM_SQL = """WITH e AS (SELECT seq, unnest(map_keys(tags)) AS k, unnest(map_values(tags)) AS v FROM points),
 w AS (SELECT seq, k, trim(lower(unnest(string_split(v, ';'))), ' ') AS word FROM e),
 t AS (SELECT 'metric' AS field, trim(lower(metric), ' ') AS term, seq FROM points WHERE trim(lower(metric), ' ') <> ''
  UNION ALL SELECT 'tags', k || '=' || word, seq FROM w WHERE word <> ''),
 c AS (SELECT field, term, count(*) AS n_occurrences, count(DISTINCT seq) AS n_records FROM t GROUP BY field, term),
 m AS (SELECT *, CASE WHEN n_records < 5 THEN 'rare' WHEN n_records > 0.4 * (SELECT count(*) FROM points) THEN 'common' END
  AS mark FROM c)"""
QUERIES["p1_found"] = p1_found
SQL["p1_found"] = TERM_SQL + " SELECT field, term, mark FROM m WHERE mark IS NOT NULL"
QUERIES["p1_terms"] = p1_terms
SQL["p1_terms"] = TERM_SQL + " SELECT field, term, n_occurrences, n_records, mark FROM m"


# ---- 5: percentiles
PERCENTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def p5_found(spark, d):
    return outlying_series(*(table(spark, d, t) for t in ("points", "metric_catalog", "series")))


def p5_percentiles(spark, d):
    """Per series and per metric and zone."""
    made = named_percentiles(*(table(spark, d, t) for t in ("points", "metric_catalog", "series")), PERCENTILES)
    return made.withColumn("value", F.round("value", 6))


READING_SQL = """r AS (SELECT DISTINCT p.series_id, p.ts, p.value FROM points p JOIN metric_catalog c
  ON split_part(p.series_id, '{', 1) = c.metric WHERE c.kind = 'gauge' AND ts IS NOT NULL AND value IS NOT NULL
  AND NOT isnan(value)),
 z AS (SELECT series_id, split_part(series_id, '{', 1) AS metric, nullif(trim(lower(tags['zone']), ' '), '') AS zone FROM series),
 v AS (SELECT r.*, z.metric, z.zone FROM r JOIN z USING (series_id))"""
QUERIES["p5_found"] = p5_found
SQL["p5_found"] = f"""WITH {READING_SQL},
 g AS (SELECT metric, zone, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v WHERE zone IS NOT NULL
  GROUP BY ALL),
 s AS (SELECT series_id, metric, zone, quantile_cont(value, 0.5) AS m FROM v WHERE zone IS NOT NULL GROUP BY ALL)
 SELECT series_id FROM s JOIN g USING (metric, zone) WHERE m > q3 + 4 * (q3 - q1) OR m < q1 - 4 * (q3 - q1)"""
QUERIES["p5_percentiles"] = p5_percentiles
SQL["p5_percentiles"] = f"""WITH {READING_SQL},
 q AS (SELECT unnest([{", ".join(f"CAST({q} AS DOUBLE)" for q in PERCENTILES)}]) AS q, unnest(range({len(PERCENTILES)})) AS i),
 u AS (SELECT 'series' AS scope, series_id AS name, value FROM v UNION ALL
  SELECT 'group', metric || '|' || zone, value FROM v WHERE zone IS NOT NULL),
 a AS (SELECT scope, name, count(*) AS n, quantile_cont(value, {list(PERCENTILES)}) AS qs FROM u GROUP BY ALL)
 SELECT scope, name, n, q.q, round(a.qs[q.i + 1], 6) AS value FROM a CROSS JOIN q"""


# ---- 6: token ids
def p6_ids(spark, d):
    return token_ids(table(spark, d, "documents"))


QUERIES["p6_ids"] = p6_ids


# ---- 7: mixing
def p7_found(spark, d):
    report = mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]
    return report.where("short AND used_tokens < target_share * whole_tokens").select("source")


def p7_report(spark, d):
    """Shares reached per source."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_mix(spark, d):
    """The documents used, with their repeats."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


QUERIES |= {"p7_found": p7_found, "p7_report": p7_report, "p7_mix": p7_mix}


# ---- 8: wrong encodings
def p8_found(spark, d):
    return garbled_texts(table(spark, d, "documents")).select("doc_id")


def p8_repaired(spark, d):
    """The restored texts."""
    return garbled_texts(table(spark, d, "documents"))


QUERIES |= {"p8_found": p8_found, "p8_repaired": p8_repaired}
