import random

import numpy as np
import pytest

from sparkquarry.llm import tiles

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component_id long, key1 long, dims int, tile int, node string, first long, links long"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], label, 1, 1, 1, 1, 1, "n", 1, 1) for i, v, label in rows], schema)


def brute(rows, threshold=0.93, single=True):
    """All pairs, in double precision."""
    vectors = []
    for _, v, _ in rows:
        v = np.array([np.nan if c is None else c for c in v or []], np.float32 if single else float).astype(float)
        vectors.append(v / np.linalg.norm(v) if v.size and np.isfinite(v).all() and v.any() else None)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _, label) in enumerate(rows):
        for b in range(a):
            if None in (i, rows[b][0], label) or label != rows[b][2] or vectors[a] is None or vectors[b] is None or len(vectors[a]) != len(vectors[b]):
                continue
            if vectors[a] @ vectors[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i) if i is not None else None
    return sorted(((rows[a][0], links[a], least[find(a)], rows[a][0] == least[find(a)]) for a in range(len(rows))), key=repr)


def found(frame, monkeypatch=None):
    return sorted((tuple(r) for r in tiles.report(frame).collect()), key=repr)


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    # The given rows have no near pairs: copies and noisy copies of some are added, among them many around the threshold.
    rng = np.random.default_rng(1)
    for k in range(250):
        i, v, label = rows[k % 40]
        noise = rng.standard_normal(len(v))
        noise *= [0, 0.1, 0.35, 0.39, 0.4, 0.45][k % 6] / np.linalg.norm(noise)
        rows.append((10_000 + k, (np.array(v) + noise).tolist(), label if k % 7 else (label + 1)))
    assert found(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("tile", [3, 40])
def test_many_tiles_and_doubt(spark, tile, monkeypatch):
    """Dense clouds about the threshold, dealt to many tiles; chains, copies and a hot label."""
    monkeypatch.setattr(tiles, "TILE", tile)
    monkeypatch.setattr(tiles, "STRIP", 7)
    rng = np.random.default_rng(tile)
    centres = rng.standard_normal((5, 12))
    rows = []
    for k in range(260):
        v = centres[k % 5] + rng.standard_normal(12) * 0.22
        rows.append((int(rng.integers(10**9)), v.tolist(), 0 if k < 200 else k % 4))
    rows += [(k, rows[0][1], 0) for k in range(30)]  # copies
    rows += [(5, rows[1][1], 0)] * 3  # repeated rows, an id that another vector has
    assert len({r[2] for r in rows}) > 1
    want = brute(rows)
    assert sum(r[1] for r in want) > 500
    assert found(table(spark, rows)) == want


def test_rows_that_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, None), (3, None, 0), (4, [], 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 3.0], 0), (7, [float("nan"), 2, 3], 0), (8, [float("inf"), 2, 3], 0)]
    rows += [(9, [1.0, 2.0], 0), (10, [2.0, 4.0], 0), (11, [1e-30, 2e-30, 3e-30], 0), (12, [1e30, 2e30, 3e30], 0), (None, v, 0), (None, v, 0), (3, v, 5)]
    assert found(table(spark, rows)) == brute(rows)


def test_doubles_strings_and_long_vectors(spark):
    """Other types of ids, labels and entries; more dimensions than one exact product takes."""
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(2_500)]
    rows = [(f"v{k:02}", [x + rng.gauss(0, 0.05 * k) for x in base], "same") for k in range(12)]
    frame = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    assert found(frame) == brute(rows, single=False)


def test_bounds_hold():
    """What is called sure is so, and no pair at the threshold is passed over."""
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((300, 24)) * rng.uniform(0.01, 50, (300, 1)) + rng.standard_normal(24) * 30

    class Side:
        pass

    side = Side()
    forms = [tiles._form(v, np.dtype("<f8")) for v in vectors]
    side.codes = np.array([np.frombuffer(f[1], np.int8) for f in forms], np.float32)
    side.step, side.error, side.n = np.array([f[2] for f in forms]), np.array([f[3] for f in forms]), np.ones(300)
    side.length = side.step * np.linalg.norm(side.codes.astype(float), axis=1)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    true = unit @ unit.T
    for threshold in (0.5, 0.9, 0.99):
        seen = np.zeros((300, 300), int)
        for i, j, sure in tiles._candidates(side, side, threshold):
            seen[i, j] = 1 + sure
        assert (seen[true >= threshold] > 0).all() and (true[seen == 2] >= threshold).all()
        assert (seen == 1).sum() < 0.2 * seen.size


def test_empty_table(spark):
    assert tiles.report(table(spark, [])).count() == 0
