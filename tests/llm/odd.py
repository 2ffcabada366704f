"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

ODD_TEXTS = [None, "", "   ", "\n\n\t", "a", "A", "a", "é", "x " * 30_000, "word" * 20_000, "one two", "one two three", "one two three four", "Ünïcödé \U0001f600 text", "tab\tand\x0bvt", "same text here", "same text here"]
ODD = [(i, t) for i, t in enumerate(ODD_TEXTS)]
#: Extra columns under names that operators use themselves.
CLASH = "doc_id long, text string, score double, fp long, component_id long, shard int, slot long, words string, n_words int, bucket int, n int, key1 long, sim long, ids string"


def frame(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(i, t, 0.5, 1, 1, 1, 1, "w", 1, 1, 1, 1, 1, "i") for i, t in rows], CLASH)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
