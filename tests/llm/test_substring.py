import hashlib
import random

import pytest

from sparkquarry.llm import substring
from tests.llm.odd import ODD, frame, words


def brute(rows, window):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(spark, rows, window):
    cut = substring.without_repeats(frame(spark, rows), window)
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in cut.collect()}


@pytest.mark.parametrize(("window", "vocab"), [(50, 30), (50, 2), (5, 3), (2, 4), (1, 9)])
def test_against_brute_force(spark, window, vocab):
    rng = random.Random(window * vocab)
    shared = [[str(rng.randrange(vocab)) for _ in range(3 * window)] for _ in range(5)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [str(rng.randrange(vocab)) for _ in range(rng.randint(0, window))]
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            text += part[a : a + rng.randint(1, 2 * window)]
        rows.append((rng.randrange(10**6) * 100 + i, rng.choice([" ", "  ", "\n"]).join(text)))
    rows += [(5 + k, rows[k][1]) for k in range(5)] + [(10**9 + i, t) for i, t in ODD if t is None or len(t) < 1000]
    assert run(spark, rows, window) == brute(rows, window)


def test_query_on_documents_with_odd_rows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [(10_000 + i, t) for i, t in ODD]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(frame(spark, rows)).collect()}
    assert got == brute(rows, 50)


def listed(found):
    return sorted((r.doc.doc_id, r.start, r.length, r.ref.doc_id, r.ref_start, r.boundary) for r in found.collect())


def test_factors_name_their_reference(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(1, text), (2, "x y " + " ".join(f"w{i}" for i in range(10, 100)) + " z")]
    found, copies = substring.factors(frame(spark, rows))
    assert listed(found) == [(2, 2, 90, 1, 10, False)]
    assert copies.count() == 0


def greedy(rows, window):
    """A parser that walks over the words of one text after the other; the reference is what no earlier text has."""
    first, out = {}, []
    for i, t in sorted(rows):
        w = words(t)
        blocks = [tuple(w[p : p + window]) for p in range(len(w) - window + 1)]
        at = 0
        while at < len(blocks):
            place = first.get(blocks[at])
            if place is None:
                at += 1
                continue
            n = 1
            while at + n < len(blocks) and first.get(blocks[at + n]) == (place[0], place[1] + n):
                n += 1
            out.append((i, at, n + window - 1, *place, False))
            behind = at + n + window - 1
            p = at + n
            while p < min(behind, len(blocks)):  # blocks that begin inside the factor and end behind it
                place = first.get(blocks[p])
                m = 1
                if place is not None:
                    while p + m < min(behind, len(blocks)) and first.get(blocks[p + m]) == (place[0], place[1] + m):
                        m += 1
                    out.append((i, p, m + window - 1, *place, True))
                p += m
            at = behind
        for p, b in enumerate(blocks):
            first.setdefault(b, (i, p))
    return sorted(out)


@pytest.mark.parametrize(("window", "vocab"), [(50, 40), (5, 3), (3, 2)])
def test_greedy_parse(spark, window, vocab):
    rng = random.Random(7 * window)
    shared = [[str(rng.randrange(vocab)) for _ in range(4 * window)] for _ in range(4)]
    rows = []
    for i in range(50):
        text = [str(rng.randrange(vocab)) for _ in range(rng.randint(0, window))]
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            text += part[a : a + rng.randint(1, 3 * window)]
        rows.append((i, " ".join(text)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # documents over several batches
    try:
        found, copies = substring.factors(frame(spark, rows), window)
        copied = {r.doc.doc_id for r in copies.collect()}
        got = listed(found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [f for f in greedy(rows, window) if f[0] not in copied]
    assert got == want and any(f[-1] for f in want) and any(not f[-1] for f in want)


def test_rows_that_share_an_id_or_have_none(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, f"{other} {text}"), (2, f"a {text}"), (None, text), (3, f"{other} b")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring.report(frame(spark, rows)).collect())
    assert got == [(0, 60, 0), (1, 60, 0), (1, 60, 0), (1, 120, 0), (2, 61, 60), (3, 61, 60)]


def test_ids_of_another_type(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([("a", text), ("b", f"x {text}")], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring.report(rows).collect()) == [("a", 0), ("b", 60)]


def test_empty_table(spark):
    assert substring.report(frame(spark, [])).count() == 0
