import hashlib
import random
import zlib

import numpy as np
import pytest

from sparkquarry.llm import periodic
from tests.llm.odd import ODD, frame, words


def brute_runs(w, least=12):
    """All maximal stretches by definition: every period, every start."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def brute_row(doc_id, text):
    w = words(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def find(texts, **options):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.array([c for t in texts for c in t], np.int64)
    return periodic.runs_of_texts(codes, offsets, **options)


@pytest.mark.parametrize("pairs_a_step", [0.0, 0.02, 1e9])  # all words frequent, some, none
def test_runs_against_definition(pairs_a_step):
    rng = random.Random(3)
    texts = [[], [1], [1] * 11, [1] * 12, [1, 2] * 6, [1, 2, 3, 4, 5, 6] * 2, [1, 2, 3, 4, 5, 6] + [1, 2, 3, 4, 5]]
    for _ in range(300):
        letters = rng.choice([1, 2, 2, 3, 5, 40])
        t = [rng.randrange(letters) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):  # repeats of repeats
            if t:
                a = rng.randrange(len(t))
                b = rng.randrange(a, min(len(t), a + 15)) + 1
                t[a:b] = t[a:b] * rng.randrange(1, 6)
        texts.append(t[:160])
    assert find(texts, pairs_a_step=pairs_a_step) == [brute_runs(t) for t in texts]


def test_counts_are_exact():
    rng = np.random.default_rng(5)
    texts = [rng.zipf(1.3, n) % 50 for n in (0, 3, 700, 2_000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for pairs_a_step in (0.0, 0.5, 1e9):
        counts, begin = periodic.lag_counts(np.concatenate(texts), offsets, pairs_a_step)
        for t, b in zip(texts, begin, strict=False):
            assert counts[b : b + len(t) // 2 + 1].tolist() == [0] + [int((t[q:] == t[:-q]).sum()) for q in range(1, len(t) // 2 + 1)]


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 4_000]
    rows += [(10_000 + i, t if t is None or len(t) < 50_000 else t[:600]) for i, t in ODD] + [(None, "a b " * 9), (7, "again " * 30), (7, "again " * 30)]
    rows += [(k, " ".join(f"w{j % 9}" for j in range(60))) for k in range(20_000, 20_060)]  # some are rewritten
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    got = periodic.report(frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        w = brute_row(i, t) if i is not None else words(t)
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {k for a, length, q in found for k in range(a + q, a + length)}
        exponent = 1000 * best[1] // best[2] if found else None
        want.append((i, len(found), *best, exponent, digest("".join(f"{a},{n},{q}\n" for a, n, q in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_very_long_texts(spark):
    """One word over and over, a long period, and two words at random: linear work, one task each."""
    rng = random.Random(1)
    block = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    coin = " ".join(rng.choice("ab") for _ in range(40_000))
    rows = [(1, "x " * 200_000), (2, " ".join(block * 5 + block[:100])), (3, coin)]
    got = {r.doc_id: r for r in periodic.collapse(frame(spark, rows)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 200_000, 1)] and got[1].text == "x"
    assert [tuple(r) for r in got[2].runs] == [(0, 150_100, 30_000)] and got[2].text == " ".join(block)
    assert got[3].n_words == 40_000 and got[3].runs


def test_empty_table(spark):
    assert periodic.report(frame(spark, [])).count() == 0
