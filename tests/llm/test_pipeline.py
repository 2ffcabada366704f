import corpus_pipeline
from pyspark.sql import functions as F
from sparkquarry.llm.common import staged
from sparkquarry.llm.simhash import similar_groups
from tests.llm.odd import ODD_TEXTS
from tests.llm.test_lines import brute


def test_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = (before, docs)
        if name != "bpe":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    before, after = seen["line_dedup"]
    assert before.count() == after.count()
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0
    want = brute([(r.doc_id, r.text) for r in before.collect()])
    lost = {r.doc_id: r.n for r in before.withColumn("n", F.size(F.split("text", "\n"))).select("doc_id", "n").collect()}
    assert {i: w[0] for i, w in want.items()} == lost
    before, after = seen["simhash_dedup"]
    groups = similar_groups(before)
    assert after.count() == groups.select("component_id").distinct().count()
    assert after.join(groups, "doc_id").filter("doc_id <> component_id").count() == 0
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = [r.text for r in seen["decontamination"][1].collect()]
    assert not any(item in text for item in items for text in left)


def test_run_takes_odd_rows(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a question of some words that nobody answers")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.collect()}
    assert {0, 8, 9} <= kept and 16 not in kept


def write(spark, folder, rows, columns, labels=(), items=((1, "a question of some words that nobody answers"),)):
    spark.createDataFrame(rows, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_empty_documents(spark, tmp_path):
    write(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_repeated_and_missing_ids(spark, tmp_path):
    line = "these are the words of a line that several of the documents have in common"
    leak = "how many red towers does the old city on the river have today"
    rows = [(1, f"{line} and more", "a", 1, 1.0), (1, "something else altogether in this row", "b", 2, 2.0), (None, f"x. {leak}", "c", 3, 3.0), (None, "a row that has no number of its own", "d", 4, 4.0), (2, f"Heading\n{leak}", "e", 5, 5.0)]
    write(spark, tmp_path, rows, "doc_id long, text string, _lines string, _row int, toxicity double", items=[(1, leak)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert after.dtypes == docs.dtypes
        docs = after
    assert sorted(r._lines for r in docs.collect()) == ["a", "b", "d"]
    assert {(r._row, r.toxicity) for r in docs.collect()} == {(1, 1.0), (2, 2.0), (4, 4.0)}
    assert staged(corpus_pipeline.encode(spark, docs, str(tmp_path)), "test-bpe").count() == 3
