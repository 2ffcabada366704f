"""Freezing a dataset as a commit: write aside, verify, publish a manifest last, refuse once frozen.

Tables are written into a folder of the attempt's own, read back and compared with what they were made from, by rows and by a
digest that does not depend on their order.  Then a manifest is created, which the file system does for one writer only; readers go by the
manifest.  Whatever an interrupted attempt leaves is in no manifest, so it is not seen and does not hinder the next.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "FROZEN.json"


class Frozen(RuntimeError):
    """The dataset is frozen already, or by somebody else meanwhile."""


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def row_digest(frame: DataFrame) -> Column:
    """Twelve hexadecimal digits of an MD5 of a row's columns by name, as a number; nulls and empty texts differ."""
    shown = [F.coalesce(F.concat(F.lit("="), F.to_json(F.col(c)) if k.startswith(("array", "struct", "map")) else F.col(c).cast("string")), F.lit("-")) for c, k in sorted(frame.dtypes)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *shown)), 1, 12), 16, 10).cast("decimal(38,0)")


def fingerprint(frame: DataFrame) -> tuple[int, str]:
    """Rows of a table and the sum of their digests, whatever their order."""
    row = frame.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_digest(frame)), F.lit(0)).cast("string").alias("d")).first()
    return row.n, row.d


def is_frozen(spark: SparkSession, path: str) -> bool:
    fs, where = _files(spark, f"{path}/{MANIFEST}")
    return fs.exists(where)


def freeze(tables: dict[str, DataFrame], path: str, about: dict | None = None, checks: list[str] | None = None) -> dict:
    """Write, verify and publish; returns the manifest.

    ``checks`` are problems found before: any of them refuses the freeze (ValueError), as does a table that is not read back as it
    was written (RuntimeError) and a dataset that is frozen (Frozen).
    """
    spark = next(iter(tables.values())).sparkSession
    if checks:
        raise ValueError(f"not frozen: {'; '.join(checks)}")
    if is_frozen(spark, path):
        raise Frozen(path)
    attempt = f"attempt-{uuid.uuid4().hex}"
    found = {}
    for name, frame in tables.items():
        there = f"{path}/{attempt}/{name}"
        frame.write.parquet(there)
        rows, digest = fingerprint(frame)
        if fingerprint(spark.read.schema(frame.schema).parquet(there)) != (rows, digest):
            raise RuntimeError(f"{name} is not what was written")
        found[name] = {"path": f"{attempt}/{name}", "rows": rows, "digest": digest, "schema": frame.schema.json()}
    manifest = {"tables": found, "about": about or {}, "frozen_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    fs, where = _files(spark, f"{path}/{MANIFEST}")
    try:
        out = fs.create(where, False)  # fails where there is one
    except Exception as error:
        raise Frozen(path) from error
    out.write(json.dumps(manifest, sort_keys=True).encode())
    out.close()
    return manifest


def manifest(spark: SparkSession, path: str) -> dict:
    """What was frozen; raises FileNotFoundError without a freeze."""
    if not is_frozen(spark, path):
        raise FileNotFoundError(f"{path}/{MANIFEST}")
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The frozen tables."""
    return {n: spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{path}/{t['path']}") for n, t in manifest(spark, path)["tables"].items()}


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``(table_name, n_rows, digest)`` of a manifest."""
    rows = [(n, t["rows"], t["digest"]) for n, t in sorted(manifest(spark, path)["tables"].items())]  # a handful of tables
    return spark.createDataFrame(rows, "table_name string, n_rows long, digest string")


def altered(spark: SparkSession, path: str) -> list[str]:
    """Frozen tables whose files no longer hold what was frozen."""
    known = manifest(spark, path)["tables"]
    return [n for n, frame in tables(spark, path).items() if fingerprint(frame) != (known[n]["rows"], known[n]["digest"])]


def data_check(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """``(question_id, task_type, question, n_gold, gold_documents, problems)``: a row for each question, as a person would check it."""
    labels = gold.groupBy("question_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("g"))
    rows = questions.join(labels, "question_id", "left").withColumn("g", F.coalesce("g", F.array().cast("array<string>")))
    problems = {"empty_question": F.trim(F.coalesce("question", F.lit(""))) == "", "no_gold_document": F.size("g") == 0}
    found = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in problems.items()])), "|")
    return rows.select("question_id", "task_type", "question", F.size("g").alias("n_gold"), F.array_join("g", "|").alias("gold_documents"), found.alias("problems"))


def card(spark: SparkSession, path: str) -> str:
    """The dataset's card: what it holds, when it was frozen and what was said about it."""
    known = manifest(spark, path)
    lines = [f"# Dataset, frozen {known['frozen_at']}", "", "| table | rows | digest |", "|---|---|---|"]
    lines += [f"| {n} | {t['rows']} | {t['digest']} |" for n, t in sorted(known["tables"].items())]
    return "\n".join([*lines, "", *(f"- {k}: {v}" for k, v in sorted(known["about"].items()))])
