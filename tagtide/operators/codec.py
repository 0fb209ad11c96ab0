"""Lossless chunk codec: second differences for times, XOR against the predecessor for doubles.

Bit lengths are computed for a whole chunk with numpy, fields are laid into one bit array, and only the
choice of the XOR window walks the values. Times are coded in ascending order. A second difference outside
32 bits, or a negative first difference, is written in the signed 64-bit form of the widest code, so every
BIGINT sequence survives a round trip.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.operators.chunks import RAW_POINT_BYTES

#: Prefix, prefix bits, payload bits and least value of each second-difference code.
DOD_CODES = (
    (0b10, 2, 7, -63, 64),
    (0b110, 3, 9, -255, 256),
    (0b1110, 4, 12, -2047, 2048),
    (0b11110, 5, 16, -32767, 32768),
)
WIDE, WIDE_BITS, WIDE_PAYLOAD = 0b111110, 6, 32
ESCAPE, ESCAPE_BITS, ESCAPE_PAYLOAD = 0b111111, 6, 64


def _lay(fields: np.ndarray, widths: np.ndarray) -> bytes:
    """Fields (uint64) of the given widths, most significant bit first, padded with zeros to whole bytes."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    owner = np.repeat(np.arange(len(widths)), widths)
    place = (ends[owner] - 1 - np.arange(total)).astype(np.uint64)
    return np.packbits(((fields[owner] >> place) & np.uint64(1)).astype(np.uint8)).tobytes()


class Bits:
    """A cursor over a byte string."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.data) * 8:
            raise EOFError("bit stream exhausted")
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)


def encode_times(ts: np.ndarray) -> bytes:
    ts = np.asarray(ts, dtype=np.int64)
    if not len(ts):
        return b""
    gaps = np.diff(ts)
    fields, widths = [ts[:1].view(np.uint64)], [np.array([64])]
    if len(gaps):
        fields += [np.array([1], np.uint64), gaps[:1].view(np.uint64)]
        widths += [np.array([1]), np.array([64])]
    dod = np.diff(gaps)
    if len(dod):
        prefix = np.full(len(dod), ESCAPE, np.uint64)
        before = np.full(len(dod), ESCAPE_BITS)
        inside = np.full(len(dod), ESCAPE_PAYLOAD)
        payload = dod.view(np.uint64).copy()
        wide = (dod >= -(2**31)) & (dod < 2**31)
        for code, n, m, low, high, at in [
            (WIDE, WIDE_BITS, WIDE_PAYLOAD, None, None, wide),
            *((c, n, m, lo, hi, (dod >= lo) & (dod <= hi)) for c, n, m, lo, hi in reversed(DOD_CODES)),
        ]:
            prefix[at], before[at], inside[at] = code, n, m
            start = dod[at] - low if low is not None else dod[at] & 0xFFFFFFFF
            payload[at] = start.astype(np.uint64)
        same = dod == 0
        prefix[same], before[same], inside[same], payload[same] = 0, 1, 0, 0
        fields.append(np.stack([prefix, payload], 1).ravel())
        widths.append(np.stack([before, inside], 1).ravel())
    return _lay(np.concatenate(fields), np.concatenate(widths).astype(np.int64))


def decode_times(data: bytes, count: int) -> np.ndarray:
    out = np.empty(count, np.int64)
    if not count:
        return out
    bits = Bits(data)
    signed = lambda x, n: x - (1 << n) if x >> (n - 1) else x
    now = signed(bits.take(64), 64)
    out[0] = now
    gap = 0
    for i in range(1, count):
        if i == 1:
            bits.take(1)
            gap = signed(bits.take(64), 64)
        elif bits.take(1):
            ones = 1
            while ones < 6 and bits.take(1):
                ones += 1
            if ones <= 4:
                _, _, m, low, _ = DOD_CODES[ones - 1]
                gap += bits.take(m) + low
            elif ones == 5:
                gap += signed(bits.take(WIDE_PAYLOAD), 32)
            else:
                gap += signed(bits.take(ESCAPE_PAYLOAD), 64)
        now = signed((now + gap) & (2**64 - 1), 64)
        gap = signed(gap & (2**64 - 1), 64)
        out[i] = now
    return out


def encode_values(values: np.ndarray) -> bytes:
    words = np.ascontiguousarray(values, dtype=np.float64).view(np.uint64)
    if not len(words):
        return b""
    fields, widths = [int(words[0])], [64]
    left, size = 64, 0
    for x in (words[1:] ^ words[:-1]).tolist():
        if not x:
            fields.append(0)
            widths.append(1)
            continue
        lead, tail = 64 - x.bit_length(), (x & -x).bit_length() - 1
        if size and lead >= left and tail >= 64 - left - size:
            fields += [0b11, x >> (64 - left - size)]
            widths += [2, size]
        else:
            left, size = lead, 64 - lead - tail
            fields += [0b10, left << 6 | (size - 1), x >> tail]
            widths += [2, 12, size]
    return _lay(np.array(fields, np.uint64), np.array(widths, np.int64))


def decode_values(data: bytes, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    bits = Bits(data)
    left = size = 0
    word = 0
    for i in range(count):
        if i == 0:
            word = bits.take(64)
        elif bits.take(1):
            if not bits.take(1):
                left, size = bits.take(6), bits.take(6) + 1
            word ^= bits.take(size) << (64 - left - size)
        out[i] = word
    return out.view(np.float64)


SEALED = (
    "series_id string, chunk_id int, n_points bigint, min_ts bigint, max_ts bigint, ts_blob binary, "
    "val_blob binary, raw_bytes bigint, compressed_bytes bigint"
)


def seal(chunks: DataFrame) -> DataFrame:
    """Encoded chunks, points in ascending (ts, seq). A group is one chunk, at most 3600 points."""

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts", "seq"])
        ts, val = encode_times(group["ts"].to_numpy()), encode_values(group["value"].to_numpy())
        first = group.iloc[0]
        return pd.DataFrame({
            "series_id": [first["series_id"]], "chunk_id": [first["chunk_id"]], "n_points": [len(group)],
            "min_ts": [group["ts"].min()], "max_ts": [group["ts"].max()], "ts_blob": [ts], "val_blob": [val],
            "raw_bytes": [len(group) * RAW_POINT_BYTES], "compressed_bytes": [len(ts) + len(val)],
        })

    cols = chunks.select("series_id", "chunk_id", "ts", "value", "seq")
    return cols.groupBy("series_id", "chunk_id").applyInPandas(encode, SEALED)


def unseal(sealed: DataFrame, t_start: int | None = None, t_end: int | None = None) -> DataFrame:
    """Points of encoded chunks; chunks outside the inclusive range are not decoded."""
    if t_start is not None:
        sealed = sealed.where(F.col("max_ts") >= int(t_start))
    if t_end is not None:
        sealed = sealed.where(F.col("min_ts") <= int(t_end))

    def decode(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                ts, val = decode_times(row.ts_blob, row.n_points), decode_values(row.val_blob, row.n_points)
                made = pd.DataFrame({"series_id": row.series_id, "chunk_id": row.chunk_id, "ts": ts, "value": val})
                if t_start is not None:
                    made = made[made["ts"] >= t_start]
                if t_end is not None:
                    made = made[made["ts"] <= t_end]
                if len(made):
                    yield made

    cols = sealed.select("series_id", "chunk_id", "n_points", "ts_blob", "val_blob")
    return cols.mapInPandas(decode, "series_id string, chunk_id int, ts bigint, value double")
