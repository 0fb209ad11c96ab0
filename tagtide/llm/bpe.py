"""Byte-level BPE of texts by a public rank file.

A text is cut by the tokenizer's pattern; each piece is merged by a segment tree over its byte positions. A leaf
holds the rank of the pair that starts at its position together with the position, so the root is the leftmost
pair of least rank. A merge changes the pairs of the merged token and its live neighbours: three leaves, each
updated up to the root, so a piece of n bytes takes O(n log n) steps whatever its content. Pieces repeat, so each
worker remembers the ids of the pieces it met in two generations of bounded size: a piece met again moves to the newer.
The rank file is shipped to the executors with the job where it lies on the driver only.

Defined cases: null and empty texts give an empty list; blank texts are encoded like any other; strings that look
like special tokens are ordinary text; texts of any length are encoded whole, in slices of bounded memory, which
end where the pattern ends a piece; invalid UTF-8 is read as U+FFFD; repeated rows give repeated rows; an empty
table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import base64
import os
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
KEPT_PIECES = 200_000
KEPT_LENGTH = 48
SLICE_PIECES = 200_000
SLICE_CHARS = 500_000
#: Ids after which the rows gathered so far are handed on.
FLUSH_IDS = 4_000_000


class PairTree:
    """The least (rank, position) over the live pairs of one piece."""

    def __init__(self, keys: list[int]):
        self.size = size = 1 << max(0, (len(keys) - 1).bit_length())
        self.nodes = nodes = [NONE] * size + keys + [NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def least(self) -> int:
        return self.nodes[1]

    def put(self, at: int, key: int) -> None:
        nodes, i = self.nodes, at + self.size
        nodes[i] = key
        while i > 1:
            other = nodes[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if nodes[i] == key:
                return
            nodes[i] = key


class Kept(dict):
    """Ids of the pieces met lately. Full, it becomes the older generation, from which pieces come back when met."""

    def __init__(self, merged):
        self.merged = merged
        self.older: dict[str, list[int]] = {}

    def __missing__(self, text: str) -> list[int]:
        ids = self.older.pop(text, None)
        if ids is None:
            ids = self.merged(text.encode())
        if len(text) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Bpe:
    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.longest = max(map(len, self.ranks))
        self.cut = regex.compile(PATTERN)
        self.kept = Kept(self.merged)

    def merged(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if n else []
        shift = n.bit_length()
        low = (1 << shift) - 1
        keys = []
        for i in range(n - 1):
            r = ranks.get(data[i : i + 2])
            keys.append(NONE if r is None else r << shift | i)
        tree = PairTree(keys)
        after, before = list(range(1, n + 2)), list(range(-1, n))

        def pair(at: int) -> int:
            mid = after[at]
            if mid >= n:
                return NONE
            end = after[mid]
            r = ranks.get(data[at:end]) if end - at <= self.longest else None
            return NONE if r is None else r << shift | at

        while (key := tree.least()) != NONE:
            at = key & low
            gone = after[at]
            end = after[at] = after[gone]
            before[end] = at
            if gone < n - 1:
                tree.put(gone, NONE)
            if at < n - 1:
                tree.put(at, pair(at))
            if (back := before[at]) >= 0:
                tree.put(back, pair(back))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[data[at : after[at]]])
            at = after[at]
        return ids

    def parts(self, text: str):
        """Arrays of ids, in order, each of a bounded number of pieces."""
        piece = self.kept.__getitem__
        if len(text) <= SLICE_CHARS:
            found = self.cut.findall(text)
            yield np.fromiter(chain.from_iterable(map(piece, found)), np.int32)
            return
        pieces = (m.group() for m in self.cut.finditer(text))
        while held := list(islice(pieces, SLICE_PIECES)):
            yield np.fromiter(chain.from_iterable(map(piece, held)), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in self.parts(text or "") for i in part]


_LOADED: dict[str, Bpe] = {}


def shipped(spark: SparkSession, path: str) -> str:
    """Send a rank file that lies on the driver along with the jobs. Executors that have the path read it there."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _LOADED[path]


def _text(value) -> str:
    return value.as_py().decode("utf-8", "replace") if value.is_valid else ""


def token_ids(documents: DataFrame, path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) per row."""

    def encode(batches):
        bpe = loaded(path)
        for batch in batches:
            lists, sizes, start = [], [0], 0
            for row, value in enumerate(batch.column(1), 1):
                made = list(bpe.parts(_text(value)))
                lists += made
                sizes.append(sizes[-1] + sum(map(len, made)))
                if sizes[-1] >= FLUSH_IDS or row == batch.num_rows:
                    flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0)[start:row], ids], [key, "ids"])
                    lists, sizes, start = [], [0], row

    shipped(documents.sparkSession, path)
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(key, F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """The kept columns and n_tokens per row."""

    def count(batches):
        bpe = loaded(path)
        for batch in batches:
            sizes = [sum(map(len, bpe.parts(_text(v)))) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "n_tokens"]
            )

    shipped(documents.sparkSession, path)
    fields = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    rows = documents.select(*keep, F.col(text).cast("binary").alias("text_"))
    return rows.mapInArrow(count, f"{fields}, n_tokens bigint")
