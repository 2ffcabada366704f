"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.llm import bpe, lines, ngram_lm, periodic, secrets, shard_tree, simhash, sql, substring, templates, tiles, toxicity, whitening, winnowing
from sparkquarry.llm.common import load

#: The folder of the public tokenizer files; None asks the package ``public_tokenizers`` for each.
TOKENIZERS = os.environ.get("QUARRY_TOKENIZERS")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return load(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_documents(spark, sf_dir), load(spark, sf_dir, "labels", "doc_id", "toxic"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(_documents(spark, sf_dir))


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_documents(spark, sf_dir))


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(_documents(spark, sf_dir), load(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.report(_documents(spark, sf_dir))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.report(_documents(spark, sf_dir))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_documents(spark, sf_dir))


def op8_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), tokenizer_file())


def op9_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_documents(spark, sf_dir))


def op10_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(load(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.report(load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def queries() -> dict:
    ours = (
        op1_toxicity, op2_winnowing, op3_secret_links, op4_template_leaks, op5_shard_tree,
        op6_kneser_ney, op7_fuzzy_lines, op8_bpe_backtracking, op9_substring_rlz, op10_simhash_ball,
        op11_periodic_runs, op12_whitening, op13_int8_tiles,
    )
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    """Hashes that SQL lacks, learned models, eigenvectors and the tokenizer leave these; the rest is tested against brute force."""
    return {"op4_template_leaks": sql.OP4, "op9_substring_rlz": sql.OP9, "op13_int8_tiles": sql.OP13}
