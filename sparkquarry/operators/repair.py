"""Repair of questions by a model: generate, check, verify, a bounded number of times, as rounds over all open rows.

A client is a function from a list of prompts to a list of answers (texts, JSON by convention).  It is called in the workers, a
batch at a time, and tried again with growing waits.  Which client that is, a service or a stand-in, is no concern of the loop.

Every round is written before the next begins: the rows that are still open with their feedback, those that are done, and a log
of what was asked and answered.  A run that is stopped goes on behind its last whole round when it is started again with the same folder,
and asks nothing twice that it has an answer to.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators import stages

Client = Callable[[list[str]], list[str]]


def ask(rows: DataFrame, client: Client, prompt: str, answer: str, tries: int = 3, wait: float = 1.0, batch: int = 16) -> DataFrame:
    """``rows`` with a column ``answer`` from the client; a batch that fails ``tries`` times fails the task, which Spark starts anew."""
    schema = rows.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found: list[str | None] = []
            for a in range(0, part.num_rows, batch):
                prompts = part.column(part.schema.get_field_index(prompt)).slice(a, batch).to_pylist()
                for turn in range(tries):
                    try:
                        answers = client(prompts)
                        break
                    except Exception:  # whatever a client raises: the network, the service, its answer
                        if turn + 1 == tries:
                            raise
                        time.sleep(wait * 2**turn)
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(prompts)} prompts were given {len(answers)} answers")
                found += answers
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, answer])

    return rows.mapInArrow(run, f"{schema}, {answer}: string")


@dataclass
class Task:
    """What a kind of question needs: prompts, checks and the rule of acceptance, as expressions of its rows."""

    issues: Callable[[DataFrame], Column]  # issue codes of the column ``question``
    generate: Column | None  # prompt; the columns question, feedback and attempt are there; None where questions are only verified
    verify: Column  # prompt for the verifier
    accepts: Callable[[Column], Column] = stages.verified
    preflight: Column | None = None  # issue codes that no question could mend


_DONE = "status string, attempts int, notes string, verdict string, issues array<string>"


def _field(payload: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(payload), f"$.decision_schema.{name}", "string"), F.try_variant_get(F.try_parse_json(payload), f"$.{name}", "string"), F.lit(""))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _kept(make: Callable[[], DataFrame], path: str, spark: SparkSession) -> DataFrame:
    """A table that is made once; what an interrupted run left of it is written over."""
    if not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _round(state: DataFrame, task: Task, generator: Client | None, verifier: Client, number: int, last: bool, folder: str, **how) -> DataFrame:
    """State after a round: open rows have a null status.  Answers are written before they are used, as every use would ask again."""
    spark = state.sparkSession
    open_ = state.filter("status is null").withColumn("attempt", F.lit(number))
    if task.generate is not None:
        prompts = open_.withColumn("_prompt", task.generate)
        asked = _kept(lambda: ask(prompts, generator, "_prompt", "_generated", **how), f"{folder}/answers/generate-{number}", spark)
        text = _field(F.col("_generated"), "question")
        open_ = asked.withColumn("question", F.trim(text)).drop("_prompt")
    else:
        open_ = open_.withColumn("_generated", F.lit(None).cast("string"))
    open_ = open_.withColumn("issues", task.issues(open_))
    fine = open_.filter(F.size("issues") == 0).withColumn("_prompt", task.verify)
    checked = _kept(lambda: ask(fine, verifier, "_prompt", "_verified", **how), f"{folder}/answers/verify-{number}", spark).drop("_prompt")
    failed = open_.filter(F.size("issues") > 0).withColumn("_verified", F.lit(None).cast("string"))
    rows = checked.unionByName(failed)
    accepted = F.col("_verified").isNotNull() & task.accepts(F.col("_verified"))
    reason = F.when(F.size("issues") > 0, F.concat(F.lit("Deterministic checks failed: "), F.array_join("issues", ", "))).otherwise(_field(F.col("_verified"), "reason"))
    rejected = F.lit(task.generate is None) & (F.lower(_field(F.col("_verified"), "verdict")) == "reject")
    ended = F.when(accepted, "accepted").when(rejected, "drop")
    ended = ended.otherwise("needs_review") if last else ended
    verdict = F.when(accepted, "accept").when(F.col("_verified").isNull(), F.col("verdict")).otherwise(F.coalesce(F.nullif(_field(F.col("_verified"), "verdict"), F.lit("")), F.lit("repair")))
    rows = rows.withColumns({"status": ended, "attempts": F.lit(number), "feedback": F.when(accepted, "").otherwise(reason), "verdict": verdict, "notes": F.when(accepted, "").otherwise(reason)})
    rows = rows.withColumnsRenamed({"_generated": "generated", "_verified": "verified"})
    before = state.filter("status is not null").withColumns({"generated": F.lit(None).cast("string"), "verified": F.lit(None).cast("string")})
    return before.unionByName(rows.drop("attempt"))


def repair(rows: DataFrame, task: Task, generator: Client | None, verifier: Client, folder: str, most: int = 3, **how) -> DataFrame:
    """``rows`` with the question as it was left, ``status`` (accepted, drop, needs_review), ``attempts``, ``notes``, ``verdict`` and ``issues``.

    ``rows(question_id, question, ...)``.  Rows that ``task.preflight`` finds hopeless are dropped without an attempt; of tasks without
    a generator questions with issues are left for review unasked.  ``how`` goes to ``ask``.
    """
    spark = rows.sparkSession
    start = rows.withColumns({"status": F.lit(None).cast("string"), "attempts": F.lit(0), "feedback": F.lit(""), "notes": F.lit(""), "verdict": F.lit(""), "issues": F.array().cast("array<string>")})
    if task.preflight is not None:
        start = start.withColumn("issues", task.preflight)
        hopeless = F.size("issues") > 0
        start = start.withColumns({"status": F.when(hopeless, "drop"), "verdict": F.when(hopeless, "preflight_drop").otherwise(""),
                                   "notes": F.when(hopeless, F.concat(F.lit("Candidate cannot satisfy subtype constraints: "), F.array_join("issues", ", "))).otherwise("")})
    if task.generate is None:
        most = 1
        start = start.withColumn("issues", F.when(F.col("status").isNull(), task.issues(start)).otherwise(F.col("issues")))
        left = F.col("status").isNull() & (F.size("issues") > 0)
        start = start.withColumns({"status": F.when(left, "needs_review").otherwise(F.col("status")), "notes": F.when(left, F.concat(F.lit("Deterministic checks failed: "), F.array_join("issues", ", "))).otherwise(F.col("notes"))})
    columns = start.columns
    for number in range(most + 1):
        made = (lambda: start) if number == 0 else (lambda: _round(state, task, generator, verifier, number, number == most, folder, **how))  # noqa: B023
        state = _kept(made, f"{folder}/rounds/round={number}", spark).select(columns)
    return state.drop("feedback")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """``(round, question_id, question, issues, generated, verified)``: what every attempt came to."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{folder}/rounds")
    return rows.filter("round > 0 and attempts = round").select("round", "question_id", "question", "issues", "generated", "verified")
