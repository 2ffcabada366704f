import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sparkquarry.llm import ngram_lm

TEXTS = [
    (1, "the cat sat on the mat"), (2, "the cat ate"), (3, "The DOG sat on the cat"), (4, ""), (5, None), (6, "  \t "),
    (7, "the cat sat on the mat"), (8, "a a a a a a"), (9, "é É the\x0bdog x\x1cy"), (10, "dog dog cat the mat on sat"),
    (11, "the dog ate the mat and the cat sat on a mat"), (12, "cat " * 300),
]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(train, texts, order):
    """Interpolated modified Kneser-Ney by the textbook, over dictionaries."""
    counts = {order: Counter()}
    for t in train:
        seq = ["<s>"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(seq)):
            counts[order][tuple(seq[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = {k: ngram_lm._discounts(*[sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]) for k, c in counts.items()}
    follow = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            follow[k][g[:-1]].append(v)
    types = len(counts[1])

    def prob(gram):
        k = len(gram)
        if not k:
            return 1 / (types + 1)
        seen = follow[k].get(gram[:-1])
        if not seen:
            return prob(gram[1:])
        d, c = [0, *disc[k]], counts[k].get(gram, 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(v, 3)] for v in seen) * prob(gram[1:])) / sum(seen)

    raw = Counter(w for t in train for w in tokens(t))
    n = sum(raw.values())
    out = []
    for t in texts:
        seq = ["<s>"] * (order - 1) + tokens(t)
        out.append((sum(math.log10(prob(tuple(seq[i - order + 1 : i + 1]))) for i in range(order - 1, len(seq))),
                    sum(math.log10((raw[w] + 1) / (n + len(raw) + 1)) for w in tokens(t)), len(tokens(t)), sum(raw[w] > 0 for w in tokens(t)), n))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_textbook(spark, order):
    docs = spark.createDataFrame([(*r, "x", 1) for r in TEXTS], "doc_id long, text string, score string, n_tokens int")
    got = {r.doc_id: r for r in ngram_lm.report(docs, order).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in TEXTS}
    assert any(held.values())
    want = brute([t for i, t in TEXTS if not held[i]], [t for _, t in TEXTS], order)
    for (i, _), (score, base, n, known, total) in zip(TEXTS, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, total)
        assert r.score == pytest.approx(score, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([r for r in TEXTS if r[1]], "doc_id long, text string")
    model = ngram_lm.train(docs, 2)
    vocab = {w for _, t in TEXTS for w in tokens(t) if w} | {"neverseen"}
    one = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(vocab))] + [(-1, "")], "doc_id long, text string")
    rows = {r.doc_id: r.score for r in ngram_lm.score(one, model).collect()}
    import numpy as np
    import pyarrow as pa

    found = ngram_lm.Model(model)
    first = {w: found.score(pa.array([w]))["score"][0] for w in vocab}
    assert set(np.round(list(first.values()), 9)) == {round(rows[i], 9) for i in range(len(vocab))}


def test_empty_and_unseen(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = ngram_lm.train(empty)
    assert ngram_lm.score(empty, model).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.score for r in ngram_lm.score(docs, model).orderBy("doc_id").collect()] == [0.0, 0.0]


def test_counts_above_a_byte(spark):
    docs = spark.createDataFrame([(i, "to be") for i in range(400)], "doc_id long, text string")
    model = ngram_lm.train(docs, 2)
    row = ngram_lm.score(docs.limit(1), model).first()
    assert row.score == pytest.approx(brute(["to be"] * 400, ["to be"], 2)[0][0], rel=1e-9)


@pytest.mark.parametrize("part_bytes", [64, 24 << 20])
def test_odd_rows_and_clashing_columns(spark, monkeypatch, part_bytes):
    """Null, empty and very long texts, repeated rows and columns of our own names; many small parts give the same as one."""
    from tests.llm.odd import ODD, frame

    monkeypatch.setattr(ngram_lm, "PART_BYTES", part_bytes)
    rows = [(i, t) for i, t in ODD if t is None or len(t) < 70_000] + [(3, "a"), (3, "a")]
    got = sorted((r.doc_id, r.n_tokens, round(r.score, 9), round(r.base_score, 9)) for r in ngram_lm.report(frame(spark, rows)).collect())
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    want = brute([t for i, t in rows if not held[i]], [t for _, t in rows], 2)
    assert got == sorted((i, w[2], round(w[0], 9), round(w[1], 9)) for (i, _), w in zip(rows, want, strict=True))


def test_few_arrays_mapped_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    docs = spark.createDataFrame([r for r in TEXTS if r[1]], "doc_id long, text string")
    model = ngram_lm.train(docs, 2)
    text = pa.array([t for _, t in TEXTS])
    want = ngram_lm.Model(model).score(text)["score"]
    monkeypatch.setattr(ngram_lm, "MAPPED", 1)
    few = ngram_lm.Model(model)
    assert few.score(text)["score"].tolist() == want.tolist() and len(few.maps) == 1
