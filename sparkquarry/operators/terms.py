"""Document keywords and lineage cuts shared by the index builders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquarry.functions import text as tx


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Only where all runs in one process (tests) is one made up; a cluster without the setting raises RuntimeError.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quarry-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(frame: DataFrame) -> DataFrame:
    """Write into the folder that the cluster names and read again, so that lineage ends and survives lost executors.

    What is read has the size of its files; a checkpoint would keep the estimate of its plan, which
    multiplies at every join and over the levels of a search outgrows any number.
    """
    path = f"{shared_dir(frame.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def document_keywords(rows: DataFrame, text: Column, most: int) -> DataFrame:
    """``(doc_id, keywords)``: the ``most`` frequent keywords of long texts, ties by first occurrence.

    Counted a batch of rows at a time, so nothing is shuffled.
    """
    kept = F.filter(tx.normal_tokens(text), tx.is_keyword)
    words = T.StructField("keywords", T.ArrayType(T.StringType()))
    return rows.select("doc_id", kept.alias("tokens")).mapInArrow(_first_tokens(most), T.StructType([rows.schema["doc_id"], words]))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Of lists the row of every value and the values; null lists are empty."""
    return pc.list_parent_indices(column).to_numpy(), pc.list_flatten(column)


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for every value, and the values of the numbers."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def _first_tokens(most: int):
    """``(doc_id, keywords)`` of ``(doc_id, tokens)``: the ``most`` frequent tokens of each row, ties by first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, values = flat_lists(batch.column("tokens"))
            code, known = codes(values)
            both = row.astype(np.int64) * max(1, len(known)) + code
            _, first, n = np.unique(both, return_index=True, return_counts=True)
            order = np.lexsort((first, -n, row[first]))
            row, first = row[first][order], first[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < most
            row, first = row[kept], first[kept]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(pa.array(code[first])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "keywords"])

    return run
