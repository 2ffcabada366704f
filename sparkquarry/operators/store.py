"""Indexes as folders of tables: saved once, loaded by as many queries as there are."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.operators.terms import shared_dir

MANIFEST = "_index"


def save(tables: dict[str, DataFrame], path: str, about: dict | None = None, mode: str = "errorifexists", layout: dict[str, tuple[str, list[str]]] | None = None) -> None:
    """Write each table below ``path``, the manifest last: a folder without one is not an index.

    ``layout`` names for a table the column of its folders and the order inside; a folder's rows may lie in several files, so that
    none is written by one task alone.  Refuses an existing folder unless ``mode`` is ``overwrite``.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, frame in tables.items():
        if name in (layout or {}):
            folder, order = layout[name]
            frame.repartition(folder, F.pmod(F.xxhash64(*order), F.lit(4))).sortWithinPartitions(folder, *order).write.mode(mode).partitionBy(folder).parquet(f"{path}/{name}")
        else:
            frame.write.mode(mode).parquet(f"{path}/{name}")
    row = json.dumps({"tables": {n: f.schema.json() for n, f in tables.items()}, "about": about or {}}, sort_keys=True)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/{MANIFEST}")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a saved index and what was said about it; raises where the manifest is missing."""
    from pyspark.sql.types import StructType

    row = json.loads(spark.read.text(f"{path}/{MANIFEST}").first()[0])
    tables = {n: spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f"{path}/{n}") for n, s in row["tables"].items()}
    return tables, row["about"]


#: Paths of the indexes that this session has built, by application, kind and source.
_BUILT: dict[tuple[str, str, str, str], str] = {}


def version(spark: SparkSession, path: str) -> str:
    """What tells a table's files from those of another time: a digest of their paths, sizes and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    row = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("v"), F.count("*").alias("n")).first()
    return f"{row.n}:{row.v}"


def _key(spark: SparkSession, kind: str, source: str, table: str | None) -> tuple[str, str, str, str]:
    return (spark.sparkContext.applicationId, kind, source, version(spark, table) if table else "")


def is_built(spark: SparkSession, kind: str, source: str, table: str | None = None) -> bool:
    """Whether ``built_once`` would load."""
    return _key(spark, kind, source, table) in _BUILT


def built_once(spark: SparkSession, kind: str, source: str, build: Callable[[], tuple[dict[str, DataFrame], dict]], layout: dict | None = None, table: str | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The index of a source: built and saved in the shared folder at first, loaded after.

    With ``table``, the path of what it is made from, it is built anew once those files have changed.
    """
    key = _key(spark, kind, source, table)
    if key not in _BUILT:
        path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
        tables, about = build()
        save(tables, path, about, layout=layout)
        _BUILT[key] = path
    return load(spark, _BUILT[key])

