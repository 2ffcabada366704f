import hashlib
import random

import pytest
import xxhash

from pyspark.sql import functions as F
from sparkquarry.llm import winnowing
from tests.llm.odd import ODD, frame, words


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_grams(text, k):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) & ((1 << 40) - 1) for w in words((text or "").lower())]

    def roll(part):
        value = part[0] if len(part) == k else 0
        for x in part[1:] if len(part) == k else part:
            value = (value * 1_000_003 + x) % ((1 << 43) - 57)
        return signed(xxhash.xxh64_intdigest((value).to_bytes(8, "little"), 42))

    return [roll(h[i : i + k]) for i in range(len(h) - k + 1)] or ([roll(h)] if h else [])


def brute(text, k=winnowing.GRAM, w=winnowing.WINDOW):
    g = brute_grams(text, k)
    places = []
    for j in range(max(1, len(g) - w + 1)) if g else []:
        part = g[j : j + w]
        at = j + max(i for i, x in enumerate(part) if x == min(part))
        if at not in places:
            places.append(at)
    return [(p, g[p]) for p in places]


def dice(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id * 7, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(100_001 + i, t) for i, t in ODD]
    got = {r.doc_id: r for r in winnowing.report(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    ordered = [(i, t or "") for i, t in sorted(rows)]
    for n, (i, t) in enumerate(ordered):
        after = ordered[(n + 1) % len(ordered)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r, own, other = got[i], brute(t), brute(edited)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        spell = lambda f: " ".join(f"{p}:{h % (1 << 64):x}" for p, h in f)
        assert (r.fingerprint, r.edited_fingerprint) == (spell(own), spell(other).lower())
        assert r.near_edited == pytest.approx(dice(own, other)) and r.near_next == pytest.approx(dice(own, brute(after)))


@pytest.mark.parametrize("rows_each", [1, 3, 10_000])
def test_next_text_over_buckets(spark, rows_each):
    rng = random.Random(rows_each)
    rows = sorted({rng.randrange(10**12): str(i) for i in range(50)}.items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    paired = winnowing.with_next(docs, rows_each).filter(~F.col("extra"))
    assert {r.doc_id: r.next_text for r in paired.collect()} == {i: rows[(n + 1) % len(rows)][1] for n, (i, _) in enumerate(rows)}


def test_shared_run_is_found(spark):
    """Any run of gram + window - 1 words in two texts gives a fingerprint in common."""
    rng = random.Random(3)
    for _ in range(20):
        run = [str(rng.random()) for _ in range(winnowing.GRAM + winnowing.WINDOW - 1)]
        a, b = ([str(rng.random()) for _ in range(rng.randint(0, 30))] + run + [str(rng.random()) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert {h for _, h in brute(" ".join(a))} & {h for _, h in brute(" ".join(b))}


def test_empty_and_single(spark):
    assert winnowing.report(frame(spark, [])).count() == 0
    r = winnowing.report(frame(spark, [(3, "just one text of a few words")])).first()
    assert r.near_next == 1.0


def test_rows_that_share_an_id_have_an_order(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven"), (2, "red green blue white black"), (2, "red green blue white grey"), (2, "red green blue white grey"), (3, "last words of all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted(map(tuple, winnowing.report(frame.coalesce(1)).collect()))
    assert len(first) == 6
    for way in (frame.repartition(5), frame.orderBy("text"), spark.createDataFrame(rows[::-1], "doc_id long, text string")):
        assert sorted(map(tuple, winnowing.report(way).collect())) == first
