"""Structured Streaming: questions scored as they arrive, events windowed and deduplicated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None, files_per_batch: int = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def score_stream(questions: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Append ``search(batch)`` of each micro-batch to ``out``; the checkpoint keeps what was answered.

    A batch that runs again overwrites its own folder, so answers are written once.
    """

    def each(batch: DataFrame, number: int) -> None:
        search(batch.dropDuplicates(["question_id"])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sums of ``value`` by tumbling window and type, repeats of an event dropped within the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(frame: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over all that is there into a memory table."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
