"""Builders of datasets whose picks depend on earlier picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkquarry.operators.terms import cut


def in_stages(stages: list[tuple[str, DataFrame, int]], source: str, order: list[str]) -> DataFrame:
    """``(stage, place, ...)``: of each stage's rows the first ``quota`` in ``order``, no source twice, in a stage or across stages.

    A stage passes over the sources that earlier stages have taken; those that an earlier stage only considered are free.  Every stage is
    written before the next looks at it.  The rows of all stages have the same columns.
    """
    picked = None
    for name, rows, quota in stages:
        free = rows if picked is None else rows.join(picked.select(source).distinct(), source, "left_anti")
        once = free.withColumn("_n", F.row_number().over(W.partitionBy(source).orderBy(*order))).filter("_n = 1").drop("_n")
        first = once.orderBy(*order).limit(quota)
        ranked = first.withColumn("place", F.row_number().over(W.orderBy(*order)))  # quota rows
        part = cut(ranked.select(F.lit(name).alias("stage"), "place", *rows.columns))
        picked = part if picked is None else picked.unionByName(part)
    return picked


def filled(corpus: DataFrame, chosen: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """``corpus(doc_id, ...)`` cut to ``target`` documents: all that are ``chosen(doc_id)``, and of the others those that a seeded draw puts first.

    Adds ``role`` (``chosen`` or ``fill``).  Fewer documents than ``target`` are all taken; more chosen ones than that are an error.
    """
    known = corpus.join(chosen.select("doc_id").distinct().withColumn("_c", F.lit(1)), "doc_id", "left")
    n = known.filter("_c = 1").count()
    if n > target:
        raise ValueError(f"{n} documents are chosen, more than {target}")
    fill = known.filter("_c is null").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), "doc_id").limit(target - n)
    return known.filter("_c = 1").unionByName(fill).withColumn("role", F.when(F.col("_c") == 1, "chosen").otherwise("fill")).drop("_c")


def quota_problems(picked: DataFrame, quotas: dict[str, int], source: str) -> DataFrame:
    """``(stage, wanted, found, sources, problem)`` for every stage; the problem is empty where the quota holds and no source is there twice."""
    want = picked.sparkSession.createDataFrame(list(quotas.items()), "stage string, wanted int")  # a handful of stages
    have = picked.groupBy("stage").agg(F.count("*").alias("found"), F.count_distinct(source).alias("sources"))
    rows = want.join(have, "stage", "left").na.fill(0, ["found", "sources"])
    problem = F.when(F.col("found") < F.col("wanted"), "too_few").when(F.col("found") > F.col("wanted"), "too_many").when(F.col("sources") < F.col("found"), "source_twice").otherwise("")
    return rows.withColumn("problem", problem)
