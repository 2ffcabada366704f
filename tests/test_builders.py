import random

import pytest

from sparkquarry.operators import builders


def test_stages_against_a_plain_loop(spark):
    rng = random.Random(2)
    stages = [(n, [(rng.randrange(12), rng.randrange(1000)) for _ in range(30)], q) for n, q in (("a", 5), ("b", 4), ("c", 0), ("d", 9))]
    used, want = set(), []
    for name, rows, quota in stages:
        taken = 0
        for source, seat in sorted(set(rows), key=lambda r: (r[1], r[0])):
            if taken < quota and source not in used:
                used.add(source)
                taken += 1
                want.append((name, taken, source, seat))
    frames = [(n, spark.createDataFrame(r, "source int, seat int").distinct(), q) for n, r, q in stages]
    got = builders.in_stages(frames, "source", ["seat", "source"])
    assert sorted(tuple(r) for r in got.select("stage", "place", "source", "seat").collect()) == sorted(want)
    problems = {r.stage: r.problem for r in builders.quota_problems(got, {n: q for n, _, q in stages}, "source").collect()}
    assert problems["a"] == problems["c"] == "" and problems["d"] == "too_few"


def test_fill(spark):
    corpus = spark.range(50).withColumnRenamed("id", "doc_id")
    chosen = spark.createDataFrame([(3,), (7,), (7,)], "doc_id long")
    got = {r.doc_id: r.role for r in builders.filled(corpus, chosen, 20).collect()}
    assert len(got) == 20 and {d for d, r in got.items() if r == "chosen"} == {3, 7}
    assert got == {r.doc_id: r.role for r in builders.filled(corpus.repartition(7), chosen, 20).collect()}
    assert builders.filled(corpus, chosen, 500).count() == 50
    with pytest.raises(ValueError, match="more than 1"):
        builders.filled(corpus, chosen, 1)
