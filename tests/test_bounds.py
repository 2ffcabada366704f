"""What a step holds or moves stays bounded: plans and peaks, not results."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sparkquarry.functions import text as tx
from sparkquarry.llm import simhash
from sparkquarry.operators import dataset, dense, fts, terms
from sparkquarry.sources import corpus as src


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_document_keywords_shuffle_nothing(spark):
    rows = spark.createDataFrame([(1, "two one two six the"), (2, ""), (3, None), (4, "abc " * 3 + "xyz " * 3 + "pqr")], "doc_id long, text string")
    found = terms.document_keywords(rows, F.col("text"), 2)
    assert "Exchange" not in plan(found)
    assert {r.doc_id: r.keywords for r in found.collect()} == {1: ["two", "one"], 2: [], 3: [], 4: ["abc", "xyz"]}


def test_relation_cues_read_the_tokens_once(spark):
    assert str(tx.relation_cues(F.col("zz"))).count("zz") == 1


def test_dense_search_holds_a_piece_of_the_scores():
    rng = np.random.default_rng(3)
    asked, own, names = rng.normal(size=(1_000, 8)), rng.normal(size=(10_000, 8)), rng.permutation(10_000)
    tracemalloc.start()
    score, ids = dense._best_of(asked, names, own, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all scores alone take 80 MB, and sorting them five times as much
    whole = asked @ own.T
    order = np.lexsort((np.broadcast_to(names, whole.shape), -np.round(whole, 9)), axis=1)[:, :5]
    assert (ids == names[order]).all() and np.allclose(score, np.take_along_axis(whole, order, 1))


def test_validation_finds_gold_once(spark, sf_dir):
    corpus, asked = src.documents_as_corpus(spark, sf_dir), src.benchmark_as_questions(spark, sf_dir)
    found = plan(dataset.validation(corpus, asked, src.gold_by_containment(asked, corpus)))
    assert "xxhash64" not in found and "/cut-" in found


def test_common_shingles_reach_the_driver_as_a_column(spark, monkeypatch):
    sizes, kind = [], type(spark.range(1))
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: sizes.append(len(rows := real(self))) or rows)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    text = " ".join(f"w{i}" for i in range(400))
    rows = spark.createDataFrame([(i, text if i < 3 else text[: 300 + i]) for i in range(6)], "doc_id long, text string")
    everything = simhash._common(rows, 2)
    assert len(everything) == 399 and (np.diff(everything.astype(object)) > 0).all() and max(sizes) < 10
    monkeypatch.setattr(simhash, "KNOWN", 200)
    most = simhash._common(rows, 2)
    assert 0 < len(most) <= 200 and set(most) <= set(everything)


def test_postings_of_chunks_are_made_in_arrays(spark, monkeypatch):
    monkeypatch.setattr(fts, "TOKENS_AT_ONCE", 5)
    corpus = spark.createDataFrame([(1, "Old Mill", ["The Mill in 1987.", "b a b", "c"]), (2, "", []), (3, "é", ["Éa é", "", "é 1 Zz"] * 3)], "doc_id long, title string, sentences array<string>")
    rows = fts.fields(fts.chunks(corpus))
    found, _ = fts.chunk_index(rows)
    want = fts._weighted(rows).select("doc_id", "chunk_no", F.size("tokens").cast("long").alias("n_tokens"), fts._summed(F.col("tokens")).alias("terms"))
    assert sorted(map(tuple, found.select("doc_id", "chunk_no", "n_tokens", "terms").collect())) == sorted(map(tuple, want.collect()))
    made = fts._posted(rows)
    assert "MapInArrow" in plan(made) and "aggregate(" not in plan(made)
