"""Cleaning of the documents table in five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns documents (the last one their
tokens).  ``run`` writes each stage's rows as Parquet into the shared folder and reads
them again for the next.

Defined results: null texts stay null; rows that share a doc_id go together where one of them is a later near duplicate;
a row without a doc_id is no near duplicate of any; further columns pass through, whatever their names; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.llm import bpe, lines, simhash, templates, toxicity
from sparkquarry.llm.common import load, sized, staged
from sparkquarry.llm.queries import tokenizer_file


#: Words that a tokenizing worker remembers; fewer than by default, as the stages share the executors' memory.
REMEMBERED = 70_000


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _like(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """Only the columns of ``docs``, with ``n_chars`` as long as the text now is."""
    if "n_chars" in docs.columns:
        frame = frame.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return frame.select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go; labels of the held-out quarter are not used."""
    model = toxicity.learn(docs, load(spark, sf_dir, "labels", "doc_id", "toxic"), toxicity.fold(F.col("doc_id")) != 2)
    name = _free("toxicity", docs)
    return toxicity.score(docs, model, name).filter(F.col(name) < toxicity.THRESHOLD).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are cut; every document stays, if only with an empty text."""
    away = {c: _free(f"kept{c}", docs) for c in docs.columns if c.lower() in lines.NAMES}
    docs = docs.withColumnsRenamed(away)
    return _like(lines.without_repeated_lines(docs), docs).withColumnsRenamed({v: k for k, v in away.items()})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the first document stays.

    Balls around SimHashes join the closest copies, an exact step those that are out of their reach.
    """
    later = staged(simhash.similar_groups(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-later")
    return docs.join(sized(later), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; rows are told apart by doc_id and text."""
    named = lambda: F.struct("doc_id", F.xxhash64("text").alias("row"))
    found = templates.leaks(docs.select(named().alias("doc_id"), "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))
    found = sized(staged(found.select(F.col("doc_id").alias("_leak")).distinct(), "pipeline-leaks"))
    name = _free("row_name", docs)
    rest = docs.withColumn(name, named())
    return rest.join(found, rest[name].eqNullSafe(found["_leak"]), "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of what they decode to."""
    coded = bpe.encode(docs, tokenizer_file(), with_decoded=True, remembered=REMEMBERED)
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SimHash, the learned stems and the tokenizer have no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
