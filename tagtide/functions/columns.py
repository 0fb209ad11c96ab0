"""Scalar expressions shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86_400


def bucket_start(ts: Column, interval) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``; floors below zero as well."""
    width = interval if isinstance(interval, Column) else F.lit(int(interval))
    return ts - F.pmod(ts, width)


def bucket_label(bucket: Column, t_start: int | None) -> Column:
    """A bucket clipped by the range start is labelled with that start."""
    return bucket if t_start is None else F.greatest(bucket, F.lit(int(t_start)))


#: One step of the offset in an order key, and the shift that makes sequence numbers non-negative.
_STEP, _SHIFT = 1 << 64, 1 << 63
#: Offsets of at least this many seconds do not fit the key.
ORDER_SPAN = 10**18


def _whole(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(20,0)")


def order_key(offset: Column, seq: Column) -> Column:
    """(offset, seq) as one DECIMAL(38) for 0 <= offset < ORDER_SPAN: aggregates ordered by it keep fixed-width buffers
    and run as hash aggregates, where a struct would have every task sort its rows first. A null seq comes first."""
    place = F.coalesce(seq.cast("decimal(20,0)"), _whole(-_SHIFT)) + _whole(_SHIFT)
    return (offset.cast("decimal(18,0)") * _whole(_STEP) + place).cast("decimal(38,0)")


def order_offset(key: Column) -> Column:
    return F.call_function("div", key, _whole(_STEP))


def order_seq(key: Column) -> Column:
    rest = key % _whole(_STEP) - _whole(_SHIFT)
    return F.nullif(rest.cast("bigint"), F.lit(Decimal(-_SHIFT)).cast("bigint"))


def _escaped(text: Column) -> Column:
    for mark in ("\\", ",", "=", "{", "}"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def series_id_of(metric: str, tags: dict[str, Column]) -> Column:
    """The id of series whose keys are known when the plan is made: plain concatenation, no map is sorted per row."""
    keys = {k: k for k in tags}
    for mark in ("\\", ",", "=", "{", "}"):
        keys = {k: v.replace(mark, "\\" + mark) for k, v in keys.items()}
    parts = [F.lit(metric + "{")]
    for i, k in enumerate(sorted(tags)):
        parts += [F.lit(("," if i else "") + keys[k] + "="), F.coalesce(_escaped(tags[k].cast("string")), F.lit(""))]
    return F.concat(*parts, F.lit("}"))


def series_id(metric: Column, tags: Column) -> Column:
    """``metric{k=v,...}`` with sorted keys. ``\\ , = { }`` inside keys and values are escaped with a
    backslash, so two different tag maps never share an id. Null or empty tags give ``metric{}``;
    a null tag value is written as the empty string."""
    entries = F.array_sort(F.map_entries(F.coalesce(tags, F.create_map().cast("map<string,string>"))))
    pairs = F.transform(
        entries,
        lambda e: F.concat(_escaped(e["key"]), F.lit("="), _escaped(F.coalesce(e["value"], F.lit("")))),
    )
    return F.concat(metric, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp column; zone-less timestamps are taken as UTC (session zone UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
