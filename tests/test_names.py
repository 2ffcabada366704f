"""Many names in texts by arrays, against ``in``."""

import numpy as np
import pyarrow as pa
import pytest

from sparkquarry.functions import names as nm
from sparkquarry.operators import graph, titles
from sparkquarry.sources import corpus as src


def first(text, names, most):
    return sorted((n for n in names if n in text), key=lambda n: (-len(n.split(" ")), n))[:most]


def drawn(rng, letters, words, n):
    return [" ".join("".join(rng.choice(list(letters), rng.integers(1, 12 if rng.random() < 0.3 else 3))) for _ in range(rng.integers(1, words))) for _ in range(n)]


@pytest.mark.parametrize("most", [None, 1, 3])
@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh1"])
def test_against_brute_force(monkeypatch, most, letters):
    monkeypatch.setattr(nm, "PAIRS", 50)
    rng = np.random.default_rng(7)
    names, texts = sorted({*drawn(rng, letters, 8, 300)}), ["", *drawn(rng, letters, 60, 60)]
    names += sorted({" ".join(w[i : i + n]) for t in texts for w in [t.split(" ")] for i in range(0, len(w), 7) for n in (1, 2, 3, 4, 6)} - {*names, ""})
    batch = pa.record_batch({"id": pa.array(range(len(texts) + 1)), "norm": pa.array([*texts, None])}).slice(0)
    monkeypatch.setattr(nm, "PIECE", 300)
    found = {i: [] for i in range(len(texts))}
    for rows in nm.finder(pa.array(names), most)([batch]):
        for i, name in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            found[i].append(name)
    assert found == {i: first(t, names, most) for i, t in enumerate(texts)}


def test_parts_of_names(spark, monkeypatch):
    rng = np.random.default_rng(8)
    names, texts = sorted({*drawn(rng, "abc", 6, 200)}), drawn(rng, "abc", 60, 20)
    monkeypatch.setattr(titles, "NAME_BYTES", 500)
    found = titles.first_contained(spark.createDataFrame(list(enumerate(texts)), "id long, norm string"), spark.createDataFrame([(n,) for n in names], "name string"), 4)
    assert sorted(map(tuple, found.collect())) == sorted((i, n) for i, t in enumerate(texts) for n in first(t, names, 4))


def test_title_links_read_texts_without_a_row_for_each_word(spark):
    corpus = spark.createDataFrame([(1, "Old Mill", "the old mill by a road"), (2, "A Road", "see old mills"), (3, "", "nothing")], "doc_id long, title string, full_text string")
    found = graph.title_links(corpus)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("1", "2"), ("2", "1")]


def test_entities_alone_need_no_graph(spark, sf_dir, monkeypatch):
    corpus = src.documents_as_corpus(spark, sf_dir).limit(20).localCheckpoint()
    rows = lambda frame: sorted(map(tuple, frame.select("entity", "degree", "idf", "spec", "cost").collect()))
    want = rows(graph.build(corpus).entities)
    monkeypatch.setattr(graph, "title_links", None)
    assert rows(graph.entities(corpus)) == want
