"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so no component is ever
gathered in one task.  The minima are written before they are joined: they are broadcast
if there are few, and else both sides of the join are bare shuffles, of which adaptive
execution can split the partitions of hot nodes.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import BROADCAST_ROWS, staged


#: Tasks that write a round of few links.
TASKS = 8


def connected_components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``links(u, v)``; the component is its smallest node.

    Links are undirected; self-links and repeats are allowed.  No links give no rows.
    Raises RuntimeError should ``most_rounds`` not be enough (the number needed grows
    with the logarithm of the longest path).
    """
    down = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down = staged(down, name)
    seen = _state(down)
    for _ in range(most_rounds):
        few = 2 * seen[0] <= BROADCAST_ROWS  # minima are one for a node, two nodes to a link at most
        least_of = lambda rows: F.broadcast(_least(rows)) if few else staged(_least(rows), f"{name}-least").hint("merge")  # noqa: B023, E731
        both = down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least_of(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = large if few else staged(large, f"{name}-large")
        joint = large.join(least_of(large), "u")
        small = joint.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joint.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        down = staged(small.coalesce(TASKS) if few else small, name)
        now = _state(down)
        if now == seen:
            ends = down.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return ends.union(down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"{name}: not at rest after {most_rounds} rounds")


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"))


def _state(links: DataFrame) -> tuple:
    """Row count and order-free checksums; equal for equal link tables."""
    both = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(both.bitwiseAND(F.lit((1 << 40) - 1))), F.sum(F.shiftrightunsigned(both, 24))).first())
