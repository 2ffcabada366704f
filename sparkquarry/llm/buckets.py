"""Links between rows that meet in buckets, without a pair for every two rows of a crowd."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import sized, staged
from sparkquarry.llm.components import connected_components

DENSE = 1_024  # rows of a bucket beyond which it is dealt anew by finer keys


def links_in_buckets(
    keyed: DataFrame,
    close: str,
    verify: Callable[[DataFrame], DataFrame],
    name: str,
    refine: Callable[[DataFrame], DataFrame] | None = None,
    dense: int | None = None,
    given: DataFrame | None = None,
) -> DataFrame:
    """``(u, v)`` links whose components are those of all similar pairs that share a bucket.

    ``keyed(bucket, id, sim)`` may hold a row in many buckets.  Pairs have to pass the
    condition ``close`` on ``a_sim`` and ``b_sim`` and then ``verify``, which gets and returns
    ``(u, v)``.

    Shared buckets are found from the keys alone.  Then each bucket's least row, its centre, is
    compared with the others, and components are formed over all buckets.  Rows in the component of
    their bucket's centre need no pairs among themselves.  Only rows outside of it are compared
    with the rest of the bucket, where the components still differ.  In a crowd of near copies
    that leaves a pair for a row.  Rows of buckets of more than ``dense`` are dealt to finer ones
    by ``refine(rows(id, sim))``, if it is given; it has to keep every close pair together somewhere.
    ``given(u, v)`` are links known before: what they connect is not compared again, and they are returned as well.
    """
    dense = DENSE if dense is None else dense
    shared = staged(keyed.select("bucket").groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), f"{name}-shared")
    met = staged(keyed.join(sized(shared), "bucket").select("bucket", "id", "sim", "n"), f"{name}-met")
    out = None
    if refine is not None:
        crowd = met.filter(f"n > {dense}").select("id", "sim").distinct()
        if crowd.take(1):
            out = links_in_buckets(refine(staged(crowd, f"{name}-crowd")), close, verify, f"{name}-fine", None, dense)
            met = met.filter(f"n <= {dense}")
    centres = met.groupBy("bucket").agg(F.min(F.struct("id", "sim")).alias("c")).select("bucket", F.col("c.id").alias("centre"), F.col("c.sim").alias("a_sim"))
    met = staged(met.join(sized(staged(centres, f"{name}-centre")), "bucket"), f"{name}-rows")
    to_centre = met.filter("id <> centre").withColumnRenamed("sim", "b_sim").filter(close).select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct()
    if given is not None:
        parts = sized(staged(connected_components(given, f"{name}-given"), f"{name}-before"))
        side = lambda key, part: parts.select(F.col("node").alias(key), F.col("component").alias(part))
        to_centre = to_centre.join(side("u", "_p"), "u", "left").join(side("v", "_q"), "v", "left").filter("not coalesce(_p, u) <=> coalesce(_q, v)").select("u", "v")
        out = given if out is None else out.union(given)
    links = staged(verify(staged(to_centre, f"{name}-pairs")).select("u", "v"), f"{name}-links")
    links = links if out is None else staged(links.union(out), f"{name}-both")
    open_rows = met.filter("n > 2")  # of two rows one is the centre
    if not open_rows.take(1):
        return links
    known = staged(connected_components(links, f"{name}-known"), f"{name}-parts")
    links, known = known.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")), sized(known)
    of = lambda rows, own, part: rows.join(known.select(F.col("node").alias(own), F.col("component").alias(f"_{part}")), own, "left").withColumn(part, F.coalesce(f"_{part}", own)).drop(f"_{part}")
    rows = staged(of(of(open_rows.filter("id <> centre").select("bucket", "id", "sim", "centre"), "id", "part"), "centre", "main"), f"{name}-others")
    away = staged(rows.filter("part <> main").select("bucket", F.col("id").alias("u"), F.col("sim").alias("a_sim"), F.col("part").alias("a")), f"{name}-away")
    # Only buckets with such rows; a pair of them is compared once.
    others = rows.join(sized(staged(away.select("bucket").distinct(), f"{name}-open")), "bucket", "left_semi")
    others = others.select("bucket", F.col("id").alias("v"), F.col("sim").alias("b_sim"), F.col("part").alias("b"), (F.col("part") != F.col("main")).alias("outside"))
    rest = away.join(others, "bucket").filter("a <> b and (u < v or not outside)").filter(close).select("u", "v").distinct()
    rest = staged(rest, f"{name}-rest")
    if not rest.take(1):
        return links
    return links.union(staged(verify(rest).select("u", "v"), f"{name}-more"))
