import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from sparkquarry.functions import text as tx

FEATURES = {
    "norm": tx.normalize_text, "tokens": tx.token_count, "entities": tx.entities, "numbers": tx.numbers_and_dates, "quotes": tx.quoted_phrases,
    "keywords": lambda c: tx.keywords(c, 5), "terms": lambda c: tx.query_terms(c, 6), "cues": lambda c: tx.relation_cues(tx.normal_tokens(c)),
}

#: Texts with what is expected of each feature, worked out by hand; what is not named is empty.
EXPECTED = {
    "": {"tokens": 1},
    " ": {"tokens": 1},
    "a b c d": {"norm": "a b c d", "tokens": 4},
    "The cat sat on the mat. The CAT!": {"norm": "the cat sat on the mat the cat", "tokens": 8, "entities": ["the cat"], "keywords": ["cat", "sat", "mat"], "terms": ["cat", "sat", "mat"]},
    'Find the document titled "Alpha Bridge" from 1999': {
        "norm": "find the document titled alpha bridge from 1999", "tokens": 8, "entities": ["alpha bridge", "find the"], "numbers": ["1999"], "quotes": ["Alpha Bridge"],
        "keywords": ["find", "document", "titled", "alpha", "bridge"], "terms": ["document", "titled", "alpha", "bridge", "1999"],
    },
    "Über Goober of the Rings and Élan": {"norm": "ber goober of the rings and lan", "tokens": 7, "entities": ["goober of the rings and"], "keywords": ["ber", "goober", "rings", "lan"], "terms": ["ber", "goober", "rings", "lan"]},
    "İstanbul 3.5 and 1999 or 12345": {"norm": "i stanbul 3 5 and 1999 or 12345", "tokens": 6, "numbers": ["12345", "1999", "3.5"], "keywords": ["stanbul", "1999", "12345"], "terms": ["stanbul", "1999", "12345", "3", "5"]},
    'He said "  inner  " and "inner"': {"norm": "he said inner and inner", "tokens": 7, "quotes": ["inner", "inner"], "keywords": ["inner", "said"], "terms": ["inner", "said"]},
    "New York City de la Cruz": {"norm": "new york city de la cruz", "tokens": 6, "entities": ["new york city de la cruz"], "keywords": ["new", "york", "city", "cruz"], "terms": ["new", "york", "city", "cruz"], "cues": ["location"]},
    "who was the director born in Old Town?": {"norm": "who was the director born in old town", "tokens": 8, "entities": ["old town"], "keywords": ["director", "born", "old", "town"], "terms": ["director", "born", "old", "town"], "cues": ["birth", "film"]},
    "Don't Stop. The End": {"norm": "don t stop the end", "tokens": 4, "entities": ["don t stop the end"], "keywords": ["don", "stop", "end"], "terms": ["don", "stop", "end"]},
    "x" * 500 + " tail": {"norm": "x" * 500 + " tail", "tokens": 2, "keywords": ["x" * 500, "tail"], "terms": ["x" * 500, "tail"]},
    "one two two three three three four five six seven": {"norm": "one two two three three three four five six seven", "tokens": 10, "keywords": ["three", "two", "one", "four", "five"], "terms": ["three", "two", "one", "four", "five", "six"]},
}


@pytest.mark.parametrize("name", FEATURES)
def test_texts_worked_out_by_hand(spark, name):
    rows = spark.createDataFrame(list(enumerate(EXPECTED)), "i int, t string").select("i", FEATURES[name](F.col("t")).alias("v")).collect()
    empty = "" if name == "norm" else []
    assert {r.i: r.v for r in rows} == {i: e.get(name, empty) for i, e in enumerate(EXPECTED.values())}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abAB the of .,'\"019-é\n", max_size=40), min_size=1, max_size=30))
def test_what_holds_of_any_text(spark, texts):
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", *[f(F.col("t")).alias(n) for n, f in FEATURES.items()], tx.keyword_set(F.col("t"), 5).alias("kept")).collect()
    for r in got:
        words = r.norm.split(" ") if r.norm else []
        assert re.fullmatch("[a-z0-9 ]*", r.norm) and all(words) and r.tokens >= 1
        assert r.entities == sorted(set(r.entities)) and all(f" {e} " in f" {r.norm} " for e in r.entities)
        assert r.numbers == sorted(set(r.numbers)) and all(n in r.t for n in r.numbers)
        assert all(p in r.t and '"' not in p for p in r.quotes) and len(r.quotes) <= r.t.count('"') // 2
        assert len(r.keywords) == len(set(r.keywords)) <= 5 and set(r.keywords) <= set(words)
        counts = [(-words.count(k), words.index(k)) for k in r.keywords]
        assert counts == sorted(counts) and set(r.kept) >= set(r.keywords)
        assert len(r.terms) == len(set(r.terms)) <= 6 and set(r.terms) <= set(words)


def test_small_functions(spark):
    one = spark.createDataFrame([("Some Title!", "[1, {\"a\": 2}] tail", [3.0, 4.0], [0.0, 0.0])], "t string, j string, v array<double>, z array<double>")
    r = one.select(
        tx.stable_doc_id(F.col("t")).alias("id"), tx.stable_sample_id(F.lit(7), F.lit(""), F.lit(None)).alias("sample"), tx.l2_normalize(F.col("v")).alias("v"), tx.l2_normalize(F.col("z")).alias("z"),
        tx.rank_to_score(F.lit(3)).alias("s"), tx.safe_ratio(F.lit(1), F.lit(0)).alias("q"), tx.parse_json_object(F.lit('noise {"a": 1} more')).cast("string").alias("json"),
        tx.forbidden_term(F.lit("An Exact phrase here"), ["exact phrase"]).alias("f1"), tx.forbidden_term(F.lit("articles"), ["article"]).alias("f2"),
        tx.entity_is_covered(F.lit("old town"), F.lit("the town is old")).alias("c"), tx.normalized_contains(F.lit("A-B c"), F.lit("b. C")).alias("n"),
    ).first()
    assert r.id.startswith("doc_some_title_") and len(r.id) == len("doc_some_title_") + 10
    assert (r.sample, r.v, r.z, r.s, r.q, r.json) == ("sample_000007", [0.6, 0.8], [0.0, 0.0], 0.5, 0.0, '{"a":1}')
    assert (r.f1, r.f2, r.c, r.n) == (True, False, True, True)


def test_truncated_texts_end_as_in_sql(spark, tmp_path):
    """Line feeds at the cut, white space that only some engines know, and texts of many words."""
    import duckdb

    from sparkquarry.plans.registry import QUERIES, SQL

    wide = [" " * n + "word\x0bwith blanks of " * 120 for n in range(3)] + [" " + "ab " * 130, "ab\n" * 60 + "c" * 300]
    cut = ["a" * (399 - n) + " " + "b" * (n - 1) + "\n" + "c d" for n in (1, 2, 9)] + ["a" * 390 + " bcdefghi\r\nrest", "a" * 395 + "\x0bbcd\nrest", None, "", " \n"]
    rows = spark.createDataFrame(list(enumerate(wide + cut)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.short for r in QUERIES["truncate_words"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == dict(con.sql(SQL["truncate_words"]).fetchall())


def test_a_run_of_capitalised_words_may_have_any_length(spark):
    n = 200_000
    rows = spark.createDataFrame([(0, "La " * n), (1, "go Thor" + " of the and" * n + " x Alpha")], "i int, t string")
    found = {r.i: r.e for r in rows.select("i", tx.entities(F.col("t")).alias("e")).collect()}
    assert found == {0: [" ".join(["la"] * n)], 1: ["alpha", "thor" + " of the and" * n]}
