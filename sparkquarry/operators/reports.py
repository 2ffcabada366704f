"""Tables derived from evaluation rows: pivots, gaps, ratios, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAL = ("dense", "file_fts", "graph_path", "fusion", "rule_router", "two_stage_agent")  # fixed values: methods that count


def method_and_split(path: Column) -> list[Column]:
    """Method and split in a summary's file name."""
    name = r"([^/]+?)_(dev|test|final|all)_summary\.json$"
    return [F.regexp_extract(path, name, 1).alias("method"), F.regexp_extract(path, name, 2).alias("split")]


def with_role(rows: DataFrame) -> DataFrame:
    return rows.withColumn("method_role", F.when(F.col("method").isin(*FORMAL), "formal").otherwise("analysis_only"))


def by_task(rows: DataFrame, value: str, tasks: list[str]) -> DataFrame:
    """Mean of a metric, methods against tasks."""
    return rows.groupBy("method").pivot("task_type", tasks).agg(F.avg(value))


def gap_to_best(rows: DataFrame, value: str) -> DataFrame:
    """``(method, task_type, value, best, gap)``: how far each method's mean is below the task's best one."""
    means = rows.groupBy("method", "task_type").agg(F.avg(value).alias("value"))
    best = means.groupBy("task_type").agg(F.max("value").alias("best"))
    return means.join(best, "task_type").withColumn("gap", F.col("best") - F.col("value"))


def cost_ratios(rows: DataFrame) -> DataFrame:
    """Per method the complete recall per thousand tokens read, the failure rate, the evidence gap and the worst task."""
    tasks = rows.groupBy("method", "task_type").agg(F.avg("complete_recall").alias("t"))
    worst = tasks.groupBy("method").agg(F.min("t").alias("worst_task"))
    means = rows.groupBy("method").agg(F.avg("complete_recall").alias("c"), F.avg("evidence_recall").alias("e"), F.avg("tokens_read").alias("r"))
    out = means.join(worst, "method")
    return out.select("method", F.when(F.col("r") > 0, 1000 * F.col("c") / F.col("r")).otherwise(0.0).alias("complete_per_kilotoken"), (1 - F.col("c")).alias("failure_rate"), (F.col("e") - F.col("c")).alias("evidence_gap"), "worst_task")


def failure_cases(ranked: DataFrame, gold: DataFrame, titles: DataFrame, top_k: int = 5) -> DataFrame:
    """Questions whose gold is not all retrieved, with the titles of gold, missed and retrieved documents."""
    got = ranked.filter(F.col("rank") <= top_k).join(titles, "doc_id").groupBy("question_id", "method").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "title"))), lambda r: r["title"]).alias("got_titles"), F.collect_set("doc_id").alias("got")
    )
    want = gold.join(titles, "doc_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "title"))).alias("gold"))
    rows = got.join(want, "question_id").withColumn("missed", F.filter("gold", lambda g: ~F.array_contains("got", g["doc_id"]))).filter(F.size("missed") > 0)
    named = lambda c: F.array_join(F.transform(c, lambda g: g["title"]), " | ")
    return rows.select("question_id", "method", F.size("gold").alias("gold_count"), named("gold").alias("gold_titles"), named("missed").alias("missed_titles"), F.array_join("got_titles", " | ").alias("retrieved_titles"))
