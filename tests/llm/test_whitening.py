import numpy as np
import pytest

from sparkquarry.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, whitened double, deviation string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    vectors = [v and [c if c is None else float(c) for c in v] for v in vectors]
    return spark.createDataFrame([(i, v, 0, 1, 1, 0.5, "d") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(vectors, components=8):
    """Rows, their exact deviations and whitened values (up to sign) from a dense eigendecomposition."""
    dims = len(vectors[0])
    x = [[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array(x, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    e, z = np.linalg.eigh(cov)
    e, z = e[::-1][: min(components, dims)], z[:, ::-1][:, : min(components, dims)]
    return n, deviation, centred @ z / np.sqrt(e), e / np.trace(cov)


def check(got, vectors, ids):
    n, deviation, white, explained = brute(vectors)
    assert len(got) == n * white.shape[1]
    place = {v: i for i, v in enumerate(ids)}
    found = np.zeros_like(white)
    for r in got:
        found[place[r.vec_id], r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[place[r.vec_id]])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
    sign = np.sign((found * white).sum(0))
    assert np.abs(found * sign - white).max() < 1e-6


def test_query_against_dense_solution(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    local = rows.select("vec_id", "embedding").collect()
    check(whitening.report(rows).collect(), [r.embedding for r in local], [r.vec_id for r in local])
    assert whitening.fit(rows).full  # eigenvalues of random vectors lie close together


def test_falling_spectrum_needs_no_full_basis(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((400, 40)) * 4.0 ** -np.arange(40) * 3e2).tolist()
    model = whitening.fit(table(spark, vectors))
    assert not model.full
    check(whitening.report(table(spark, vectors)).collect(), vectors, range(400))


def test_rows_that_do_not_count(spark):
    rng = np.random.default_rng(4)
    good = rng.standard_normal((60, 5)).tolist()
    good += good[:7]  # repeated rows count twice
    odd = [None, [], [None] * 5, [1.0, float("nan"), 0, 0, 0], [float("inf"), 0, 0, 0, 0], [1.0, 2.0], [1e30, 0, 0, 0, 0], [1.0, None, 3.0, 4.0, 5.0]]
    ids = [*range(67), *range(1_000, 1_000 + len(odd))]
    check(whitening.report(table(spark, good + odd, ids)).collect(), good, ids)


def test_no_variance_and_empty(spark):
    assert whitening.report(table(spark, [])).count() == 0
    assert whitening.report(table(spark, [None, [float("nan")]])).count() == 0
    assert whitening.report(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    line = whitening.report(table(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)


def test_deviation_beyond_64_bits_is_null(spark):
    got = whitening.report(table(spark, [[1e9], [-1e9], [0.0], [5.0]])).collect()
    assert [r.deviation is None for r in sorted(got, key=lambda r: r.vec_id)] == [True, True, False, False]


def test_null_ids_stay(spark):
    got = whitening.report(table(spark, [[1.0, 0.0], [0.0, 1.0], [2.0, 5.0]], [None, None, 3])).collect()
    assert [r.vec_id for r in got].count(None) == 4
