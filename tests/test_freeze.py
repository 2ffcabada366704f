import pytest

from pyspark.sql import functions as F
from sparkquarry.operators import dataset, freeze, fusion, metrics


def test_freeze_once_and_read(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = spark.range(50).select("id", F.concat(F.lit("q"), "id").alias("question"), F.array(F.lit("a"), F.lit(None)).alias("gold"))
    made = freeze.freeze({"questions": rows, "empty": rows.limit(0)}, path, {"source": "test"})
    assert made["tables"]["questions"]["rows"] == 50 and made["tables"]["empty"]["rows"] == 0
    assert sorted(r.id for r in freeze.tables(spark, path)["questions"].collect()) == list(range(50))
    assert [(r.table_name, r.n_rows) for r in freeze.listing(spark, path).orderBy("table_name").collect()] == [("empty", 0), ("questions", 50)]
    assert freeze.altered(spark, path) == [] and "- source: test" in freeze.card(spark, path)
    with pytest.raises(freeze.Frozen):
        freeze.freeze({"questions": rows}, path)
    spark.range(50).select((F.col("id") + 1).alias("id"), F.lit("x").alias("question"), F.array(F.lit("a")).alias("gold")).write.mode("overwrite").parquet(f"{path}/{made['tables']['questions']['path']}")
    assert freeze.altered(spark, path) == ["questions"]


def test_interrupted_attempt_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    rows = spark.range(10)
    boom = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stopped"))).otherwise("x").cast("string").alias("v"))
    with pytest.raises(Exception, match="stopped"):
        freeze.freeze({"a": rows, "b": boom}, path)
    assert not freeze.is_frozen(spark, path)
    with pytest.raises(FileNotFoundError):
        freeze.tables(spark, path)
    with pytest.raises(ValueError, match="no gold"):
        freeze.freeze({"a": rows}, path, checks=["no gold"])
    # Another writer is first, after this one has looked.
    freeze.freeze({"a": rows}, path)
    monkeypatch.setattr(freeze, "is_frozen", lambda *_: False)
    with pytest.raises(freeze.Frozen):
        freeze.freeze({"a": spark.range(3)}, path)
    monkeypatch.undo()
    assert freeze.tables(spark, path)["a"].count() == 10


def test_digest_is_free_of_order_and_sees_every_column(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "", "x"), (2, "", "x")], "i int, s string, t string")
    same = freeze.fingerprint(rows)
    assert freeze.fingerprint(rows.orderBy(F.desc("i")).select("t", "i", "s").repartition(3)) == same
    for other in ([(1, "a", ""), (2, "", "x"), (2, "", "x")], [(1, "a", None), (2, "", "x")], [(1, "a", None), (2, "x", ""), (2, "", "x")]):
        assert freeze.fingerprint(spark.createDataFrame(other, "i int, s string, t string")) != same


def test_private_keys_with_paths(spark):
    rows = [(1, '{"a": {"answer": 1, "b": [{"gold_documents": []}, [{"answer": {"answer": null}}]]}}'), (2, '{"answers": 1, "x": "answer"}'), (3, "[1, 2]"), (4, None), (5, "not json"), (6, '{"corpus_role": {}}')]
    got = sorted((r.id, r.path, r.key) for r in dataset.private_findings(spark.createDataFrame(rows, "id int, payload string"), "payload", "id").collect())
    assert got == [(1, ".a.answer", "answer"), (1, ".a.b[0].gold_documents", "gold_documents"), (1, ".a.b[1][0].answer", "answer"), (1, ".a.b[1][0].answer.answer", "answer"), (6, ".corpus_role", "corpus_role")]
    assert dataset.private_findings(spark.createDataFrame([], "id int, payload string"), "payload", "id").count() == 0


def test_merge_keeps_ranks_and_weights(spark):
    lists = lambda rows: spark.createDataFrame(rows, "question_id int, rank int, doc_id string, title string, tool string")
    first, second = lists([(1, 1, "a", "A", "dense"), (1, 2, "b", "B", "dense")]), lists([(1, 1, "b", "B", "file_fts"), (1, 2, "c", "C", "file_fts")])
    decisions = spark.createDataFrame([(1, 1.1, 1.25, 1)], "question_id int, first_weight double, second_weight double, protect int")
    got = {r.doc_id: r for r in fusion.protected_merge(first, second, decisions, maps=True).collect()}
    assert got["a"].ranks == {"dense": 1} and got["b"].ranks == {"dense": 2, "file_fts": 1} and got["c"].weights == {"file_fts": 1.25}
    assert [got[d]["rank"] for d in "abc"] == [1, 2, 3]


def test_exact_resamples_follow_the_published_rule(spark):
    import random

    values = {"a": [float(i % 3 == 0) for i in range(37)], "b": [0.5]}
    want = {}
    for g, v in values.items():
        rng = random.Random(42)
        means = sorted(sum(v[rng.randrange(len(v))] for _ in v) / len(v) for _ in range(200))
        want[g] = (means[5], means[194])
    rows = spark.createDataFrame([(g, x, i) for g, v in values.items() for i, x in enumerate(v)], "g string, v double, i int").repartition(5)
    got = {r.g: (r.low, r.high) for r in metrics.exact_ci(rows, "g", "v", "i", samples=200).collect()}
    assert {g: (pytest.approx(a), pytest.approx(b)) for g, (a, b) in want.items()} == got
    with pytest.raises(Exception, match="too many"):
        metrics.exact_ci(rows, "g", "v", "i", samples=200, most=10).collect()
