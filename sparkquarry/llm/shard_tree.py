"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels.  At each level every child draws
``-ln(u) / weight`` with ``u`` a hash of key and child name, and the least draw wins, so
a child is chosen in proportion to its weight and its draw depends on nothing else.
When a weight changes, keys move only into or out of the subtree whose weight changed;
inside other subtrees nothing moves.  A cluster therefore grows by a new region (with
its rack and shard): no other node's weight changes and keys move only into it.

The draws are columns: placing a key reads neither a table nor its neighbours.

Slots number the rows of a shard from 0 without gaps, in the order of a hash of the key,
so that a shard read by slot is shuffled.  Rows are ranked inside buckets (leading bits
of that hash), whose offsets come from a table of bucket counts; no task holds a shard.

Defined results: null and empty texts have size 1 and CRC 0; a null key is placed by the
empty string; rows with the same key share a shard and have slots of their own; an
empty table gives no rows; extra columns are ignored unless named.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A region, rack or shard.  A shard has a number and a weight; others weigh what they hold."""

    name: str
    children: tuple[Node, ...] = field(default=())
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def build(regions: Iterable[Iterable[Iterable[tuple[int, float]]]]) -> Node:
    """A tree from nested lists: regions of racks of (shard, weight)."""
    out = []
    for r, racks in enumerate(regions):
        inner = []
        for k, shards in enumerate(racks):
            leaves = tuple(Node(f"r{r}/k{k}/s{s}", shard=s, own_weight=w) for s, w in shards)
            inner.append(Node(f"r{r}/k{k}", leaves))
        out.append(Node(f"r{r}", tuple(inner)))
    return Node("", tuple(out))


def even(shards: int, base: int = 8) -> Node:
    """Equal shards: the first ``base`` in two regions of two racks, each later one in a region of its own."""
    first = min(shards, base)
    regions: list[list[list[tuple[int, float]]]] = [[[], []], [[], []]]
    for s in range(first):
        regions[s * 2 // base][s * 4 // base % 2].append((s, 1.0))
    regions = [[rack for rack in region if rack] for region in regions]
    return build([*[r for r in regions if r], *([[(s, 1.0)]] for s in range(first, shards))])


def _draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw with the weight as its rate, from 53 bits of a 64-bit hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit("@" + name))), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(weight)


def place(key: Column, tree: Node) -> Column:
    """Shard of each key: the least draw of each level, from the root down."""
    text = F.coalesce(key.cast("string"), F.lit(""))

    def down(node: Node) -> Column:
        if not node.children:
            return F.lit(node.shard)
        live = [c for c in node.children if c.weight > 0]
        if not live:
            raise ValueError(f"no weight below {node.name or 'the root'}")
        if len(live) == 1:
            return down(live[0])
        draws = [_draw(text, c.name, c.weight) for c in live]
        best = F.least(*draws)
        choice = F.when(draws[0] == best, down(live[0]))
        for d, c in zip(draws[1:], live[1:], strict=True):
            choice = choice.when(d == best, down(c))
        return choice

    return down(tree).cast("int")


def with_slots(frame: DataFrame, shard_col: str, key_col: str, rows: int, bucket_rows: int = 20_000) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard.  ``rows`` is about how many rows there are."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / bucket_rows)))
    order = F.xxhash64(F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.lit("slot"))
    bucket = F.shiftrightunsigned(order, 63 - bits).cast("long") if bits else F.shiftrightunsigned(order, 63).cast("long")
    frame = frame.withColumn("_bucket", bucket)
    counts = frame.groupBy(shard_col, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard_col).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard_col, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(shard_col, "_bucket").orderBy(F.shiftrightunsigned(order, 1), key_col)
    ranked = frame.withColumn("_rank", F.row_number().over(inside))
    return ranked.join(offsets, [shard_col, "_bucket"]).withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_rank", "_before")


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Size, checksum, shard, slot and the shard under one more shard, for every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), even(shards)).alias("shard"),
        place(F.col("doc_id"), even(shards + 1)).alias("grown_shard"),
    )
    rows = docs.select("doc_id").count()
    return with_slots(placed, "shard", "doc_id", rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
