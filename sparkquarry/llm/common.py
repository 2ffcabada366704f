"""Helpers shared by the corpus operators: table access, shared storage, Arrow tokens."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes a Python worker handles at once; keeps its memory flat for long documents.
SLICE_BYTES = 8 << 20

#: Java and SQL pattern of the white space that ends a word: space and 0x09-0x0D.
SPACE = "[\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; only they reach the scan."""
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the setting is absent and all runs in one process, as in tests;
    a cluster without the setting raises RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quarry-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: lineage ends there,
    so lost executors cost a re-read and not a recomputation."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Rows of at most a few dozen bytes that are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def sized(frame: DataFrame, weight: str = "1", most: int = BROADCAST_ROWS) -> DataFrame:
    """A written frame to join with, broadcast if its rows are few, else sorted and merged.

    ``weight`` is an expression for how many rows one row stands for (the length of an array).
    The choice is explicit so that it does not change with the statistics at hand.
    """
    rows = frame.agg(F.coalesce(F.sum(F.expr(weight)), F.lit(0))).first()[0]
    return F.broadcast(frame) if rows <= most else frame.hint("merge")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cut = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def words(text: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words between runs of space and 0x09-0x0D, over all rows, and the rows' offsets into them.

    A null counts as an empty text.  ``lower`` maps A-Z only.
    """
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    split = pc.ascii_split_whitespace(text)
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():
        before = np.concatenate([[0], np.cumsum(keep)])
        flat, offsets = flat.filter(full), before[offsets]
    return flat, offsets


def joined(flat: pa.Array, offsets: np.ndarray) -> pa.Array:
    """Each row's words joined by one space."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
    return pc.binary_join(lists, " ")


_HELD: dict = {}


def held(key, make):
    """The one object that a Python worker keeps between tasks.

    Workers serve one operator after the other; what an earlier one kept (a tokenizer and its
    words, a mapped model) goes when another asks.
    """
    if key not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[key] = make()
    return _HELD[key]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * _M1
        x = x ^ (x >> np.uint64(27))
        x = x * _M2
        return x ^ (x >> np.uint64(31))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word of the call is hashed once."""
    import xxhash

    if not len(flat):
        return np.empty(0, np.uint64)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()]


def local_path(path: str) -> str | None:
    """The path itself where the shared folder is mounted like a disk, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith(os.sep) else None
