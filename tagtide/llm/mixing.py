"""Mixing sources to target shares of all tokens.

The whole is cut into blocks of equal token size, and blocks are given to sources by Sainte-Lague: the next block
goes to the highest quotient weight / (2 * blocks + 1). A source's blocks go to its shards by the same rule,
weighted by the shards' tokens, never above what a shard holds times the repeats allowed; they pass down a tree of FAN
children a node, so no step ever sees more than FAN shards or groups of shards together. Within a shard documents
are put in a seeded order and used from the start, round after round, until the quota is filled; a document is
used when its first token lies within the quota. What a small source cannot fill is reported, not given to others,
so no source exceeds its share for another's lack. A source falls short when its blocks exceed what it can fill.

The number of shards follows the tokens, so the ordered work of one task stays bounded whatever share one source
holds. Only sums reach the apportionment: one row per source of the targets, then one per shard in groups of FAN.

Defined cases: documents whose source is null or has no target take no part; null and empty texts have no tokens
and are never chosen; a source without documents fills nothing; a null share counts as 0 and a null repeat limit
as 0 uses; a source listed twice in the targets keeps its least row; ties of quotients go to the lower name;
repeated document rows are documents of their own; empty tables give rows of zeros for the sources listed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.bpe import VOCABULARY, token_counts
from tagtide.operators.blocks import written

BLOCK_TOKENS = 256
SHARD_TOKENS = 1 << 21
#: Children of a node in the tree of shards. Two levels hold 16 million shards, 35 million million tokens.
FAN = 4096
LEVELS = 2
#: Stands for all blocks of a source that holds fewer than it was given.
FULL = -1


def apportion(weights, seats: int, limits=None) -> np.ndarray:
    """Sainte-Lague seats per weight, each at most its limit. A divisor found by bisection gives all but the last
    few seats at once, so millions of seats cost no more than a few."""
    w = np.maximum(np.nan_to_num(np.asarray(weights, float)), 0.0)
    cap = np.full(len(w), max(0, seats)) if limits is None else np.clip(np.asarray(limits, np.int64), 0, max(0, seats))
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum())) if len(w) else 0
    given = np.zeros(len(w), np.int64)
    if seats <= 0:
        return given
    at = lambda d: np.minimum(np.floor(w / d + 0.5), cap).astype(np.int64)
    low, high = 0.0, 4.0 * w.max()
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if at(mid).sum() > seats:
            low = mid
        else:
            high = mid
    given = at(high)
    heap = [(-w[i] / (2 * given[i] + 1), i) for i in range(len(w)) if given[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * given[i] + 1), i))
    return given


def clean_targets(targets: DataFrame) -> DataFrame:
    rows = targets.where(F.col("source").isNotNull()).select(
        "source",
        F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(0)).alias("max_repeats"),
    )
    return rows.groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")


def sized(documents: DataFrame, targets: DataFrame, path: str, shard_tokens: int) -> DataFrame:
    """(doc_id, source, n_tokens, shard) of the documents that take part, written once: counting is the cost."""
    own = documents.select("doc_id", "source", "text").join(clean_targets(targets).select("source"), "source")
    counted = written(token_counts(own, ["doc_id", "source"], path))
    shards = counted.select(F.greatest(F.lit(1), F.ceil(F.sum("n_tokens") / shard_tokens)).cast("bigint")).scalar()
    return counted.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.coalesce(shards, F.lit(1))))


def source_blocks(sizes: DataFrame, targets: DataFrame, block_tokens: int, total_tokens: int | None) -> DataFrame:
    """(source, max_repeats, blocks, lacks): the blocks of each source, all apportioned together, one row per source of
    the targets. ``lacks`` marks sources whose blocks reach what their documents can fill, to within one block for every
    source, which is as far as Sainte-Lague may lie off an exact share."""
    totals = sizes.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    whole = clean_targets(targets).join(totals, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)))

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source")
        blocks = int(round((rows["held"].sum() if total_tokens is None else total_tokens) / block_tokens))
        can = rows["held"] * rows["max_repeats"] // block_tokens
        free = apportion(rows["target_share"], blocks)
        return pd.DataFrame({
            "source": rows["source"], "max_repeats": rows["max_repeats"], "blocks": np.where(free > can, FULL, free),
            "lacks": free + len(rows) > can,
        })

    return whole.groupBy().applyInPandas(share, "source string, max_repeats bigint, blocks bigint, lacks boolean")


def shard_quotas(sizes: DataFrame, given: DataFrame, block_tokens: int) -> DataFrame:
    """(source, shard, held, max_repeats, quota) in tokens. The blocks of a source go down the tree of its shards, at
    every node by Sainte-Lague among its children."""
    per = sizes.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held"))
    can = F.col("held") * F.col("max_repeats")
    leaves = per.join(given.select("source", "max_repeats", "blocks"), "source").select(
        "source", "shard", "held", "max_repeats", F.col("blocks").alias("all_blocks"),
        F.ceil(can / block_tokens).cast("bigint").alias("most"),
    )

    def among_children(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        blocks = int(rows["blocks"].iloc[0])
        made = np.full(len(rows), FULL) if blocks == FULL else apportion(rows["weight"], blocks, rows["most"])
        return pd.DataFrame({"source": rows["source"], "node": rows["node"], "blocks": made})

    node = lambda level: F.floor(F.col("shard") / FAN**level).cast("bigint")
    above = given.select("source", F.lit(0).cast("bigint").alias("parent"), "blocks")
    for level in reversed(range(LEVELS)):
        parent = node(level + 1) if level < LEVELS - 1 else F.lit(0).cast("bigint")
        nodes = leaves.groupBy("source", node(level).alias("node"), parent.alias("parent")).agg(
            F.sum("held").alias("weight"), F.sum("most").alias("most")
        )
        made = nodes.join(above, ["source", "parent"]).groupBy("source", "parent")
        spread = made.applyInPandas(among_children, "source string, node bigint, blocks bigint")
        above = spread.withColumnRenamed("node", "parent")
    quota = F.when(F.col("blocks") == FULL, can).otherwise(F.col("blocks") * block_tokens).cast("bigint")
    return leaves.join(above.withColumnRenamed("parent", "shard"), ["source", "shard"]).select(
        "source", "shard", "held", "max_repeats", quota.alias("quota")
    )


def chosen(sizes: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents used at least once."""
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "n_tokens")
    start = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.withColumn("start", F.coalesce(start, F.lit(0))).join(quotas, ["source", "shard"])
    rounds = F.floor(F.col("quota") / F.col("held")) + (F.col("start") < F.col("quota") % F.col("held")).cast("bigint")
    repeats = F.when((F.col("held") > 0) & (F.col("n_tokens") > 0), F.least(rounds, "max_repeats")).otherwise(0)
    return (
        placed.where(F.col("held") > 0)
        .withColumn("repeats", repeats)
        .where(F.col("repeats") > 0)
        .select("doc_id", "source", "n_tokens", "repeats")
    )


def mixture(
    documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = 1,
    block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, total_tokens: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their repeats, and the report per source: tokens held and used, the share reached
    and whether the source falls short: its blocks of the whole reach what it can fill, and exactly counted its
    documents, each used as often as allowed, hold less than its share of the whole. The mixture is as large as the
    whole of the sources, or has ``total_tokens``."""
    sizes = sized(documents, targets, path, shard_tokens)
    given = source_blocks(sizes, targets, block_tokens, total_tokens)
    picked = chosen(sizes, shard_quotas(sizes, given, block_tokens), seed)
    lacking = (given if total_tokens is None else source_blocks(sizes, targets, block_tokens, None)).select("source", "lacks")
    used = picked.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.sum("repeats").alias("uses")
    )
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("held_tokens"), F.count(F.lit(1)).alias("n_docs"))
    rows = clean_targets(targets).join(held, "source", "left").join(used, "source", "left").join(lacking, "source")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("held_tokens", "n_docs", "used_tokens", "uses")}
    every = Window.partitionBy()
    report = (
        rows.withColumns(zero)
        .withColumn("whole_tokens", F.sum("held_tokens").over(every))
        .withColumn("share_reached", F.try_divide(F.col("used_tokens").cast("double"), F.sum("used_tokens").over(every)))
        .withColumn(
            "short",
            F.col("lacks") & (F.col("held_tokens") * F.col("max_repeats") < F.col("target_share") * F.col("whole_tokens")),
        )
        .drop("lacks")
    )
    return picked, report
