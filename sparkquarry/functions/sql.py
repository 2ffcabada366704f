"""The text features as SQL functions, and chunks as a table function, for use from ``spark.sql``.

``register(spark)`` creates temporary SQL functions.  They are SQL themselves, so the optimiser sees through them as through any expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sparkquarry.functions import text as tx

#: Sentences of a chunk and how far the next one begins behind.
CHUNK, STRIDE = 3, 2


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def definitions() -> dict[str, str]:
    """Each function's parameters, type and body."""
    cues = ", ".join(f"CASE WHEN arrays_overlap(normal_tokens(content), array({_listed(words)})) THEN '{name}' END" for name, words in sorted(tx.RELATIONS.items()))
    kept = f"filter(normal_tokens(content), t -> length(t) > 2 AND t NOT IN ({_listed(tx.STOPWORDS)}))"
    ranked = f"array_sort(transform(array_distinct({kept}), t -> struct(-size(filter({kept}, x -> x = t)) AS n, array_position({kept}, t) AS at, t AS token)))"
    useful = f"t -> t NOT IN ({_listed(tx.QUERY_STOPWORDS)}) AND (length(t) > 2 OR t RLIKE '^[0-9]+$')"
    chunks = f"""SELECT n, s, least(s + {CHUNK}, size(sentences)) - 1, array_join(slice(sentences, s + 1, {CHUNK}), ' ')
      FROM (SELECT posexplode(filter(sequence(0, greatest(size(sentences) - 1, 0), {STRIDE}), s -> size(sentences) > 0 AND (s = 0 OR s + {CHUNK - STRIDE} < size(sentences)))) AS (n, s))"""
    return {
        "normalize_text(content STRING) RETURNS STRING": "trim(regexp_replace(lower(content), '[^a-z0-9]+', ' '))",
        "normal_tokens(content STRING) RETURNS ARRAY<STRING>": "filter(split(normalize_text(content), ' '), t -> t <> '')",
        "estimate_tokens(content STRING) RETURNS INT": "greatest(1, size(filter(split(content, r'(?U)\\s+'), t -> t <> '')))",
        "simple_entities(content STRING) RETURNS ARRAY<STRING>": f"array_sort(array_distinct(filter(transform(regexp_extract_all(content, {_quoted(tx.ENTITY)}, 0), e -> trim(regexp_replace(lower(e), '[^a-z0-9]+', ' '))), e -> e <> '' AND e NOT IN ({_listed(tx.STOPWORDS)}))))",
        "numbers_and_dates(content STRING) RETURNS ARRAY<STRING>": f"array_sort(array_distinct(regexp_extract_all(content, {_quoted(tx.NUMBER)}, 0)))",
        "quoted_phrases(content STRING) RETURNS ARRAY<STRING>": f"transform(regexp_extract_all(content, {_quoted(tx.QUOTED)}, 1), p -> trim(p))",
        "keywords(content STRING, most INT) RETURNS ARRAY<STRING>": f"transform(slice({ranked}, 1, most), e -> e.token)",
        "query_terms(content STRING, most INT) RETURNS ARRAY<STRING>": f"slice(array_distinct(filter(concat(keywords(content, 2 * most), normal_tokens(content)), {useful})), 1, most)",
        "relation_cues(content STRING) RETURNS ARRAY<STRING>": f"array_compact(array({cues}))",
        "chunks(sentences ARRAY<STRING>) RETURNS TABLE (chunk_no INT, sentence_start INT, sentence_end INT, body STRING)": chunks,
    }


def register(spark: SparkSession) -> list[str]:
    """Create all functions in this session; returns their names."""
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in definitions()]
