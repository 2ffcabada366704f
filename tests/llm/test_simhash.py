import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sparkquarry.llm import simhash
from tests.llm.odd import ODD, frame, words


def brute_print(text, k=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def brute_groups(prints, linked):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_xxh64_matches_library():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(130), 1000, 4096]]
    start = np.cumsum([0, *map(len, parts)])[:-1]
    got = simhash.xxh64(b"".join(parts), start, np.array([len(p) for p in parts]))
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in ODD]
    got = {r.doc_id: r for r in simhash.report(frame(spark, rows)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    groups = brute_groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: r.component_id for i, r in got.items()} == groups


@pytest.mark.parametrize("seed", range(3))
def test_links_keep_all_components(spark, seed):
    """Clouds of fingerprints a few flips apart, chains among them."""
    rng = random.Random(seed)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                centre ^= 1 << b
            prints.add(centre)
    prints = dict(enumerate(sorted(prints)))
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "node long, fp long")
    from sparkquarry.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.links(nodes)).collect()}
    assert {i: got.get(i, i) for i in prints} == brute_groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)


def test_empty_table(spark):
    assert simhash.report(frame(spark, [])).count() == 0
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def jaccard(a, b, k=5):
    sets = []
    for t in (a, b):
        w = words((t or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("dense", [64, 3])
def test_similar_groups(spark, monkeypatch, dense):
    monkeypatch.setattr("sparkquarry.llm.buckets.DENSE", dense)
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    rows, n = [], 0
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((n, " ".join(own)))
            n += 1
    rows += [(10_000 + i, t) for i, t in ODD]
    text = dict(rows)
    want = brute_groups(text, lambda a, b: jaccard(text[a], text[b]) >= 0.8)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert all(want[got[i]] == want[i] for i in text)  # never joins what is apart
    apart = sum(got[i] != want[i] for i in text)
    assert apart <= 0.1 * sum(want[i] != i for i in text)


def test_repeated_words_beyond_a_slice():
    text = "a b c " * 400_000
    assert int(simhash.simhash(pa.array([text, "x"]))[0, 0]) == brute_print(text)


def groups_as_wanted(spark, rows):
    text = dict(rows)
    want = brute_groups(text, lambda a, b: jaccard(text[a], text[b]) >= 0.8)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()} == want
    return want


@pytest.mark.parametrize("dense, sampled", [(64, 16), (3, 1)])
def test_every_pair_at_the_least_similarity_is_found(spark, monkeypatch, dense, sampled):
    monkeypatch.setattr("sparkquarry.llm.buckets.DENSE", dense)
    monkeypatch.setattr(simhash, "SAMPLED", sampled)
    monkeypatch.setattr(simhash, "COMMON", 2)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, rows = " ".join(word() for _ in range(40)), []
    for _ in range(120):
        base = [word() for _ in range(94)]  # 90 shingles, ten of them replaced: 80 of 100 are common
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:84], *(word() for _ in range(10))]))]
    rows += [(1_000 + i, f"{shared} {' '.join(word() for _ in range(30))}") for i in range(30)]  # a passage that unlike texts share
    passage = " ".join(word() for _ in range(60))
    rows += [(2_000, f"{passage} {shared}"), (2_001, f"{passage} " + f"{shared} " * 30)]  # one repeats a part many times
    assert sum(k != v for k, v in groups_as_wanted(spark, rows).items()) == 121


def test_equal_simhash_is_no_equal_text(spark):
    """A phrase repeated so often that it decides every bit, before tails of their own."""
    rng = random.Random(8)
    phrase = " ".join(f"phrase{i}" for i in range(9))
    rows = [(i, f"{phrase} " * 200 + " ".join(f"w{rng.randrange(10**9)}" for _ in range(150))) for i in range(6)]
    assert len({int(p) for p in simhash.simhash(pa.array([t for _, t in rows]), 5)[:, 0]}) < len(rows)
    assert all(k == v for k, v in groups_as_wanted(spark, rows).items())
