"""Queries of readers, writers, saved indexes and the stages of building a question set, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.functions import sql as sql_text
from sparkquarry.functions import text as tx
from sparkquarry.operators import builders, dataset, dense, freeze, fts, fusion, graph, metrics, questions, repair, reports, routing, samples, stages, store
from sparkquarry.operators.terms import shared_dir
from sparkquarry.plans import agent
from sparkquarry.plans.registry import (
    _CHUNKS, _CORPUS, _EVAL, _basic_sql, _bootstrap_sql, _ents, _kws, _nums, _terms_sql, _EVAL_FTS, _LOG, _QUESTIONS, _ROUTED, _STOP, _dense_index, _fts_index, _graph_index, _joined, _log_evaluation, _norm, _ranked_log, _toks, query,
)
from sparkquarry.sources import corpus as src
from sparkquarry.streaming import two_stage


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- readers and writers --------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def jsonl_round_trip(spark, sf_dir):
    rows, path = src.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), _folder(spark, "jsonl")
    src.write_jsonl(rows, path)
    return src.read_jsonl(spark, path, rows.schema).select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_round_trip(spark, sf_dir):
    rows, path = src.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_retailprice"), _folder(spark, "csv")
    src.write_csv(rows, path)
    return src.read_csv(spark, path, rows.schema)


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY event_type")
def append_log(spark, sf_dir):
    """A log written by two runs, the second of which appends."""
    rows, path = src.table(spark, sf_dir, "events", "event_id", "event_type", "value"), _folder(spark, "log")
    src.write_jsonl(rows.filter("event_id % 2 = 0"), path)
    src.write_jsonl(rows.filter("event_id % 2 <> 0"), path, "append")
    return src.read_jsonl(spark, path, rows.schema).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT n_regionkey, count(DISTINCT h) AS files, any_value(h) AS sha256 FROM (SELECT n_regionkey, sha256(string_agg(n_name || chr(10), '' ORDER BY n_name)) AS h FROM nation GROUP BY n_regionkey) GROUP BY n_regionkey")
def file_digests(spark, sf_dir):
    """Digests of the files that a run left, one for each region."""
    path = _folder(spark, "files")
    rows = src.table(spark, sf_dir, "nation", "n_regionkey", "n_name")
    rows.repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(path)
    found = src.file_hashes(spark, f"{path}/*/*.txt").withColumn("n_regionkey", F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int"))
    return found.groupBy("n_regionkey").agg(F.count_distinct("sha256").alias("files"), F.any_value("sha256").alias("sha256"))


@query(f"WITH {_CORPUS} SELECT doc_id, md5(title) AS title, md5(text) AS full_text, CAST(len(sentences) AS BIGINT) AS n_sentences, 0::BIGINT AS n_sources, 0::BIGINT AS n_metadata FROM corpus")
def public_corpus(spark, sf_dir):
    """What a retriever may see of a corpus that knows more."""
    private = src.documents_as_corpus(spark, sf_dir).withColumns({"source_question_ids": F.array(F.col("doc_id").cast("string")), "metadata": F.create_map(F.lit("corpus_role"), F.lit("noise"))})
    rows = src.public_corpus(private)
    size = lambda c: F.size(c).cast("long")
    return rows.select("doc_id", F.md5("title").alias("title"), F.md5("full_text").alias("full_text"), size("sentences").alias("n_sentences"), size("source_question_ids").alias("n_sources"), size(F.map_keys("metadata")).alias("n_metadata"))


@query(f"WITH {_CORPUS} SELECT doc_id, md5(trim(title || '. ' || text, ' ')) AS dense_text FROM corpus")
def dense_texts(spark, sf_dir):
    return src.documents_as_corpus(spark, sf_dir).select("doc_id", F.md5(tx.document_text(F.col("title"), F.col("full_text"))).alias("dense_text"))


_SAMPLES = f"""{_CORPUS}, s AS (SELECT 's' || doc_id // 10 AS sample_id, 'doc_' || doc_id AS title, sentences, doc_id FROM corpus),
  facts AS (SELECT sample_id, title, CAST(doc_id % 7 - 1 AS INT) AS sent_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(sentences[doc_id % 7], '') END AS text FROM s WHERE doc_id % 3 < 2)"""


def _nested_samples(spark, sf_dir) -> DataFrame:
    """Ten documents as a sample with parallel arrays, two thirds of them named by facts; some facts point outside."""
    rows = src.documents_as_corpus(spark, sf_dir).select(F.concat(F.lit("s"), F.floor(F.col("doc_id") / 10)).alias("id"), "doc_id", F.concat(F.lit("doc_"), "doc_id").alias("title"), "sentences")
    fact = F.when(F.col("doc_id") % 3 < 2, F.struct("title", (F.col("doc_id") % 7 - 1).cast("int").alias("sent_id")))
    made = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "title", "sentences"))).alias("c"), F.array_sort(F.collect_list(fact)).alias("f"), F.min("doc_id").alias("low"))
    return made.select(
        "id", F.when(F.col("low") % 20 == 0, "").otherwise(F.concat(F.lit("which of "), "id", F.lit("?"))).alias("question"), F.when(F.col("low") % 30 == 0, "Yes ").otherwise("both").alias("answer"),
        F.struct(F.col("c.title").alias("title"), F.col("c.sentences").alias("sentences")).alias("context"), F.struct(F.col("f.title").alias("title"), F.col("f.sent_id").alias("sent_id")).alias("supporting_facts"),
    )


@query(f"WITH {_SAMPLES} SELECT sample_id, title, sent_id, md5(text) AS text FROM facts")
def nested_facts(spark, sf_dir):
    return src.supporting_sentences(_nested_samples(spark, sf_dir)).select("sample_id", "title", "sent_id", F.md5("text").alias("text"))


@query(f"""WITH {_SAMPLES}, lows AS (SELECT sample_id, min(doc_id) AS low FROM s GROUP BY sample_id), g AS (SELECT sample_id, count(DISTINCT title) AS titles, bool_or(trim(text, ' ') <> '') AS any_text, bool_and(trim(text, ' ') <> '') AS all_text FROM facts GROUP BY sample_id)
  SELECT sample_id AS id, coalesce(titles >= 2 AND any_text, false) AND low % 20 <> 0 AS usable, coalesce(titles = 2 AND all_text, false) AND low % 20 <> 0 AND low % 30 <> 0 AS good FROM lows LEFT JOIN g USING (sample_id)""")
def sample_filters(spark, sf_dir):
    nested = _nested_samples(spark, sf_dir)
    facts = src.supporting_sentences(nested)
    usable = samples.usable_samples(facts, nested).select("id", F.lit(True).alias("usable"))
    good = samples.good_samples(facts, nested).select("id", F.lit(True).alias("good"))
    rows = nested.select("id").join(usable, "id", "left").join(good, "id", "left")
    return rows.select("id", F.coalesce("usable", F.lit(False)).alias("usable"), F.coalesce("good", F.lit(False)).alias("good"))


@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS squares FROM embeddings")
def saved_vectors(spark, sf_dir):
    """Vectors saved as an index and loaded, joined with what they belong to."""
    rows = src.table(spark, sf_dir, "embeddings")
    tables, _ = store.built_once(spark, "dense-index", sf_dir, lambda: ({"vectors": rows.select("vec_id", "embedding")}, {"dimensions": 64}), table=f"{sf_dir}/embeddings.parquet")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", "label").join(tables["vectors"], "vec_id").select("vec_id", "label", F.round(squares, 4).alias("squares"))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)
  SELECT vec_id, round(embedding[1] / CASE WHEN n = 0 THEN 1 ELSE n END, 5) AS first, round(embedding[64] / CASE WHEN n = 0 THEN 1 ELSE n END, 5) AS last FROM n""")
def unit_vectors(spark, sf_dir):
    rows = dense.normalized(src.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return rows.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.get("embedding", F.lit(63)).cast("double"), 5).alias("last"))


# ---- features of questions and documents ----------------------------------------------------------------------------


@query(f"SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(k), lambda t: {{'a': list_position(k, t), 't': t}})), lambda e: e.t), '|') AS words FROM (SELECT item_id, list_filter({_toks('text')}, lambda t: len(t) > 2 AND NOT list_contains({_STOP}, t)) AS k FROM benchmark)")
def content_words(spark, sf_dir):
    return src.table(spark, sf_dir, "benchmark").select("item_id", _joined(tx.content_words(F.col("text"))).alias("words"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || doc_id WHEN doc_id % 3 = 1 THEN lang ELSE printf('sample_%06d', doc_id) END AS sample_id FROM documents")
def sample_ids(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    first = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.lit(""))
    second = F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return rows.select("doc_id", tx.stable_sample_id(F.col("doc_id"), first, second).alias("sample_id"))


@query(f"""SELECT a.p_partkey, {_norm('b.p_name')} <> '' AND contains({_norm('a.p_name')}, {_norm('b.p_name')}) AS inside FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2""")
def normalised_containment(spark, sf_dir):
    rows = src.table(spark, sf_dir, "part", "p_partkey", "p_name")
    other = rows.select(F.col("p_partkey").alias("half"), F.col("p_name").alias("needle"))
    return rows.join(other, F.col("half") == F.floor(F.col("p_partkey") / 2)).select("p_partkey", tx.normalized_contains(F.col("p_name"), F.col("needle")).alias("inside"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 3 WHEN o_orderkey % 4 = 1 THEN 2 WHEN o_orderkey % 4 = 2 THEN 4 ELSE 1 END AS calls FROM orders""")
def inferred_calls(spark, sf_dir):
    rows = src.table(spark, sf_dir, "orders", "o_orderkey")
    kind = F.col("o_orderkey") % 4
    none = F.array().cast("array<string>")
    calls = samples.tool_calls(F.when(kind == 0, F.lit(3)), F.when(kind == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(none), F.when(kind == 2, F.array(*[F.lit(x) for x in "abcd"])).otherwise(none))
    return rows.select("o_orderkey", calls.alias("calls"))


# ---- stages of a question set ---------------------------------------------------------------------------------------

_SPLIT = f"""{_QUESTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY md5('42:' || question_id), question_id) AS p, count(*) OVER (PARTITION BY task_type) AS n FROM questions),
  sp AS (SELECT question_id, task_type, question, CASE WHEN p <= greatest(1, least(n - 1, round_even(n * 0.3, 0))) THEN 'dev' ELSE 'test' END AS split FROM r)"""


def _split_questions(spark, sf_dir) -> DataFrame:
    return dataset.split_dev_test(src.benchmark_as_questions(spark, sf_dir), "task_type", "question_id", 0.3)


@query(f"WITH {_SPLIT} SELECT question_id, split FROM sp WHERE split = 'dev'")
def dev_questions(spark, sf_dir):
    return stages.of_split(_split_questions(spark, sf_dir), "dev").select("question_id", "split")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND trim(text, ' ') <> '' AND turn % 5 <> 0")
def accepted_rows(spark, sf_dir):
    rows = src.table(spark, sf_dir, "conversations")
    sheet = rows.withColumns({"status": F.when(F.col("role") == "user", "accepted").otherwise("needs_review"), "rewritten_question": F.when(F.col("turn") % 5 != 0, F.col("text"))})
    return stages.accepted(sheet, "rewritten_question").select("conv_id", "turn")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def sheet_with_pool(spark, sf_dir):
    sheet = src.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_custkey", "key")
    pool = src.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").withColumnRenamed("c_custkey", "key")
    return stages.with_pool(sheet, pool, "key").select("o_orderkey", F.col("key").alias("o_custkey"), "c_name", "c_mktsegment")


@query(f"""WITH {_QUESTIONS}, r AS (SELECT question_id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY question_id) AS n FROM questions)
  SELECT question_id, task_type FROM r WHERE n <= CASE task_type WHEN 'semantic_fact' THEN 7 ELSE 6 END""")
def quota_selection(spark, sf_dir):
    most = stages.quotas(19, ["semantic_fact", "multi_hop_relation", "exact_file_lookup"])
    return stages.by_quota(src.benchmark_as_questions(spark, sf_dir), "task_type", "question_id", most).select("question_id", "task_type")


@query("""WITH st AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'first' WHEN l_returnflag = 'A' THEN 'second' ELSE 'third' END AS stage, l_partkey AS source, l_orderkey * 10 + l_linenumber AS seat FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY list_position(['first', 'second', 'third'], stage), seat) AS n FROM st) SELECT source, stage, seat FROM r WHERE n = 1""")
def unused_sources(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    stage = F.when(F.col("l_returnflag") == "R", "first").when(F.col("l_returnflag") == "A", "second").otherwise("third")
    rows = rows.select(stage.alias("stage"), F.col("l_partkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seat"))
    return stages.first_unused(rows, ["first", "second", "third"], "source", "seat").select("source", "stage", "seat")


_PAYLOAD = "event_id % 2 = 0 AS answerable, event_id % 3 > 0 AS single_answer, event_id % 5 > 0 AS grounded, event_id % 7 = 0 AS leaks_title"


@query(f"WITH p AS (SELECT event_id, {_PAYLOAD} FROM events) SELECT event_id, answerable, single_answer, grounded, leaks_title, answerable AND single_answer AND grounded AND NOT leaks_title AS accepted FROM p")
def verifier_flags(spark, sf_dir):
    """Answers of a verifier, a third of them with their flags one level down and a wrong one on top."""
    at = lambda m: F.col("event_id") % m
    inner = F.struct((at(2) == 0).alias("answerable"), (at(3) > 0).alias("single_answer"))
    deep = F.to_json(F.struct(inner.alias("decision_schema"), (at(2) != 0).alias("answerable"), (at(5) > 0).alias("grounded"), (at(7) == 0).alias("leaks_title")))
    flat = F.to_json(F.struct((at(2) == 0).alias("answerable"), (at(3) > 0).alias("single_answer"), (at(5) > 0).alias("grounded"), (at(7) == 0).alias("leaks_title")))
    rows = src.table(spark, sf_dir, "events", "event_id").withColumn("answer", F.when(at(3) == 1, deep).otherwise(flat))
    return rows.select("event_id", *[c.alias(n) for n, c in stages.decisions(F.col("answer")).items()], stages.verified(F.col("answer")).alias("accepted"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || event_id WHEN 1 THEN 'b' || event_id WHEN 2 THEN 'c' || event_id END AS first_round FROM events")
def first_round_documents(spark, sf_dir):
    own = lambda letter: F.array(F.concat(F.lit(letter), F.col("event_id").cast("string")))
    kind = F.col("event_id") % 4
    rounds = F.array(F.struct(own("c").alias("documents")))
    made = F.when(kind == 0, F.to_json(F.struct(own("a").alias("first_round_documents"), rounds.alias("rounds"))))
    made = made.when(kind == 1, F.to_json(F.struct(F.struct(own("b").alias("first_round_documents")).alias("metadata"), rounds.alias("rounds"))))
    made = made.when(kind == 2, F.to_json(F.struct(rounds.alias("rounds")))).otherwise("{}")
    rows = src.table(spark, sf_dir, "events", "event_id").withColumn("log", made)
    return rows.select("event_id", F.array_join(stages.first_round_ids(F.col("log")), "|").alias("first_round"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE (o_orderkey % 1000) // 10 || '.' || (o_orderkey % 1000) % 10 || '%' END AS share FROM orders")
def percentages(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 1000) / 1000)
    return src.table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", stages.percent(value).alias("share"))


@query("SELECT o_orderkey, regexp_extract('results/' || lower(o_orderstatus) || 'x_router_' || CASE WHEN o_orderkey % 2 = 0 THEN 'dev' ELSE 'test' END || '_summary.json', '([^/]+?)_(dev|test|final|all)_summary\\.json$', 1) AS method, CASE WHEN o_orderkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM orders")
def method_names(spark, sf_dir):
    name = F.concat(F.lit("results/"), F.lower("o_orderstatus"), F.lit("x_router_"), F.when(F.col("o_orderkey") % 2 == 0, "dev").otherwise("test"), F.lit("_summary.json"))
    return src.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", *reports.method_and_split(name))


@query(f"""WITH {_QUESTIONS}, r AS (SELECT task_type, md5(concat_ws(chr(31), CAST(question_id AS VARCHAR), question, task_type)) AS h FROM questions)
  SELECT task_type, count(*) AS questions, md5(string_agg(h, '' ORDER BY h)) AS digest FROM r GROUP BY task_type""")
def freeze_record(spark, sf_dir):
    return stages.freeze_record(src.benchmark_as_questions(spark, sf_dir), ["question_id", "question", "task_type"])


@query("""WITH u AS (SELECT doc_id, 0 AS seq, 'a' || doc_id AS title, 'noise' AS role, ['x' || doc_id % 3] AS ids FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 1, 'b' || doc_id, CASE WHEN doc_id % 5 = 0 THEN 'candidate_gold' ELSE 'selected_gold' END, ['y', 'x' || doc_id % 3] FROM documents WHERE doc_id % 3 = 0)
  SELECT doc_id, arg_min(title, seq) AS title, arg_max(role, CASE role WHEN 'candidate_gold' THEN 2 WHEN 'noise' THEN 0 ELSE 1 END) AS role, array_to_string(list_sort(list_distinct(flatten(list(ids)))), '|') AS source_ids FROM u GROUP BY doc_id""")
def merged_corpora(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents", "doc_id")
    x = F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string"))
    one = rows.filter("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("a"), "doc_id").alias("title"), F.lit("noise").alias("role"), F.array(x).alias("source_ids"))
    role = F.when(F.col("doc_id") % 5 == 0, "candidate_gold").otherwise("selected_gold")
    two = rows.filter("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("b"), "doc_id").alias("title"), role.alias("role"), F.array(F.lit("y"), x).alias("source_ids"))
    return dataset.merge_corpora([one, two]).select("doc_id", "title", "role", F.array_join("source_ids", "|").alias("source_ids"))


@query("SELECT c_custkey, printf('cand_%s_%04d', c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey)) AS new_id FROM customer")
def running_ids(spark, sf_dir):
    return dataset.sequential_ids(src.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), "cand", "c_mktsegment", "c_custkey").select("c_custkey", "new_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0")
def private_key_rows(spark, sf_dir):
    """Rows that carry a private key in a map, whose keys no schema tells."""
    held = F.create_map(F.when(F.col("o_orderkey") % 6 == 0, "gold_documents").otherwise("note"), F.lit("x"))
    return dataset.private_rows(src.table(spark, sf_dir, "orders", "o_orderkey").withColumn("metadata", held)).select("o_orderkey")


@query(f"SELECT a.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey % 50 + 1 WHERE {_norm('b.p_name')} <> '' AND contains({_norm('a.p_name')}, {_norm('b.p_name')})")
def leaked_titles(spark, sf_dir):
    rows = src.table(spark, sf_dir, "part", "p_partkey", "p_name").withColumnRenamed("p_name", "question")
    titles = src.table(spark, sf_dir, "part", "p_partkey", "p_name").filter("p_partkey <= 50").select((F.col("p_partkey") - 1).alias("slot"), F.col("p_name").alias("title"))
    return dataset.title_leaks(rows.join(F.broadcast(titles), F.col("p_partkey") % 50 == F.col("slot"))).select("p_partkey")  # fifty rows


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'drop' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'accepted' WHEN o_orderkey % 5 < 3 THEN 'retry' ELSE 'needs_review' END AS status FROM orders")
def repair_states(spark, sf_dir):
    key = F.col("o_orderkey")
    issues = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("question_too_short")))
    return src.table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", questions.repair_status(issues, key % 2 == 0, key % 5, 3, key % 11 == 0).alias("status"))


# ---- evaluation -----------------------------------------------------------------------------------------------------


@query(f"""WITH {_EVAL}, a AS (SELECT * FROM ev WHERE method = 'click' AND k = 5), b AS (SELECT * FROM ev WHERE method = 'view' AND k = 5)
  SELECT question_id, b.matched - a.matched AS gain, CASE WHEN question_id % 3 = 0 THEN NULL WHEN a.complete_recall = 1 THEN CAST(question_id % 3 = 1 AND b.complete_recall = 1 AS DOUBLE) ELSE CAST(question_id % 3 <> 1 AS DOUBLE) END AS stop_accuracy
  FROM a JOIN b USING (question_id)""")
def second_round_values(spark, sf_dir):
    rows = _log_evaluation(spark, sf_dir).filter("k = 5")
    of = lambda m, n: rows.filter(F.col("method") == m).select("question_id", F.col("matched").alias(f"m{n}"), (F.col("complete_recall") == 1).alias(f"c{n}"))
    both = of("click", 1).join(of("view", 2), "question_id")
    stopped = F.when(F.col("question_id") % 3 != 0, F.col("question_id") % 3 == 1)
    return both.select("question_id", metrics.evidence_gain(F.col("m1"), F.col("m2")).cast("long").alias("gain"), metrics.stop_accuracy(F.col("c1"), stopped, F.col("c2")).alias("stop_accuracy"))


@query(f"""WITH {_LOG}, f AS (SELECT question_id, doc_id, sum(1.0 / (60 + rank))::DOUBLE AS score, min(title) AS title FROM log GROUP BY ALL),
  fr AS (SELECT question_id, 'fusion' AS method, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, title, doc_id) AS rank, doc_id FROM f),
  every AS (SELECT question_id, method, rank, doc_id FROM log UNION ALL SELECT question_id, method, rank, doc_id FROM fr WHERE rank <= 5)
  SELECT method, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS docs FROM every WHERE rank <= 5 GROUP BY method""")
def methods_with_fusion(spark, sf_dir):
    rows = _ranked_log(spark, sf_dir)
    every = fusion.with_fusion(rows)
    return every.filter("rank <= 5").groupBy("method").agg(F.count("*").alias("n"), F.sum("doc_id").alias("docs"))


@query(f"""WITH {_EVAL}, x AS (SELECT *, least(retrieved, 3) AS tool_calls, CASE WHEN question_id % 4 > 0 THEN matched - 1 END AS gain, CASE WHEN question_id % 3 > 0 THEN question_id % 2 END AS stop FROM ev)
  SELECT method, CAST(k AS BIGINT) AS k, round(avg(evidence_recall), 6) AS evidence_recall, round(avg(complete_recall), 6) AS complete_recall, round(avg(complete_recall), 6) AS search_success, round(avg(mrr), 6) AS mrr,
  round(avg(tool_calls), 6) AS tool_calls, round(avg(latency_ms), 4) AS latency_ms, round(avg(tokens_read), 6) AS text_read_tokens, round(avg(gain), 6) AS evidence_gain_step2, round(avg(stop), 6) AS stop_accuracy,
  round(quantile_cont(latency_ms, 0.95), 4) AS latency_p95, count(*) AS n FROM x GROUP BY method, k""")
def full_summary(spark, sf_dir):
    rows = _log_evaluation(spark, sf_dir).withColumns({
        "search_success": F.col("complete_recall"), "tool_calls": F.least("retrieved", F.lit(3)), "text_read_tokens": F.col("tokens_read"),
        "evidence_gain_step2": F.when(F.col("question_id") % 4 > 0, F.col("matched") - 1), "stop_accuracy": F.when(F.col("question_id") % 3 > 0, F.col("question_id") % 2),
    })
    found = metrics.full_summary(rows)
    exact = {"latency_ms": 4, "latency_p95": 4}
    return found.select("method", F.col("k").cast("long"), "n", *[F.round(c, exact.get(c, 6)).alias(c) for c in (*metrics.ALL_MEANS, "latency_p95")])


# ---- methods over a split -------------------------------------------------------------------------------------------


def retrievers(spark: SparkSession, sf_dir: str) -> dict:
    """The three tools over the saved indexes of a source."""
    words, built = _fts_index(spark, sf_dir), _graph_index(spark, sf_dir)
    as_text = lambda rows: rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return {
        "file_fts": lambda q: as_text(fts.search(q, words)), "graph_path": lambda q: graph.search(q, built),
        "dense": lambda q: as_text(dense.search(q, _dense_index(spark, sf_dir), words.docs)),
    }


def evaluated(spark: SparkSession, sf_dir: str, methods: list[str], split: str = "all", ks: tuple[int, ...] = metrics.KS) -> DataFrame:
    """Evaluation rows of methods on the questions of a split; ``rule_router`` asks the tool that each question is routed to."""
    asked = stages.of_split(_split_questions(spark, sf_dir), split)
    tools = retrievers(spark, sf_dir)
    if unknown := set(methods) - {*tools, "rule_router"}:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    found = None
    for name in methods:
        public = src.public_questions(asked)
        rows = agent.by_tool(routing.route(public), "tool", tools).drop("tool") if name == "rule_router" else tools[name](public)
        rows = rows.withColumns({"method": F.lit(name), "latency_ms": F.lit(None).cast("double")})
        found = rows if found is None else found.unionByName(rows)
    corpus = src.documents_as_corpus(spark, sf_dir)
    gold = src.gold_by_containment(asked, corpus).withColumn("doc_id", F.col("doc_id").cast("string"))
    return metrics.evaluate(found, gold, asked, ks)


@query(f"""WITH {_EVAL_FTS}, m AS (SELECT question_id, task_type, k, gold_count, matched, CASE WHEN gold_count > 0 THEN matched / gold_count ELSE 0 END AS er, coalesce(1.0 / first, 0)::DOUBLE AS mrr FROM e WHERE k <> 5)
  SELECT m.question_id, m.task_type, CAST(k AS BIGINT) AS k, CAST(matched AS BIGINT) AS matched, round(er, 6) AS evidence_recall, round(mrr, 6) AS mrr
  FROM m JOIN (WITH {_SPLIT} SELECT question_id FROM sp WHERE split = 'test') USING (question_id)""")
def split_of_full_text(spark, sf_dir):
    rows = evaluated(spark, sf_dir, ["file_fts"], "test", stages.parse_ks("3,1"))
    return rows.select("question_id", "task_type", F.col("k").cast("long"), F.col("matched").cast("long"), F.round("evidence_recall", 6).alias("evidence_recall"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {_ROUTED}, g AS (SELECT question_id, CAST(doc_id AS VARCHAR) AS doc_id FROM questions q JOIN documents d ON contains(d.text, q.question)), gc AS (SELECT question_id, count(*) AS n FROM g GROUP BY ALL),
  e AS (SELECT q.question_id, q.task_type, k, coalesce(gc.n, 0) AS gold_count, count(g.doc_id) AS matched, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS first
    FROM questions q JOIN a_found f ON f.question_id = q.question_id CROSS JOIN (SELECT unnest([1, 3, 5]) AS k) LEFT JOIN gc ON gc.question_id = q.question_id LEFT JOIN g ON g.question_id = q.question_id AND g.doc_id = f.doc_id WHERE rank <= k GROUP BY ALL)
  SELECT question_id, 'rule_router' AS method, task_type, CAST(k AS BIGINT) AS k, CAST(matched AS BIGINT) AS matched, round(CASE WHEN gold_count > 0 THEN matched / gold_count ELSE 0 END, 6) AS evidence_recall, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS mrr FROM e""")
def rule_router(spark, sf_dir):
    rows = evaluated(spark, sf_dir, ["rule_router"])
    return rows.select("question_id", "method", "task_type", F.col("k").cast("long"), F.col("matched").cast("long"), F.round("evidence_recall", 6).alias("evidence_recall"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {_EVAL}, f AS (SELECT *, method || '/' || k AS grp FROM ev), {_bootstrap_sql('f', 'grp', 'evidence_recall', 'e_')}, {_bootstrap_sql('f', 'grp', 'complete_recall', 'c_')}
  SELECT method, CAST(k AS BIGINT) AS k, round(avg(evidence_recall), 6) AS evidence_recall, round(any_value(e_ci.low), 6) AS evidence_recall_low, round(any_value(e_ci.high), 6) AS evidence_recall_high,
  round(any_value(c_ci.low), 6) AS complete_recall_low, round(any_value(c_ci.high), 6) AS complete_recall_high FROM f JOIN e_ci ON e_ci.g = grp JOIN c_ci ON c_ci.g = grp GROUP BY method, k""")
def summary_intervals(spark, sf_dir):
    """A summary with its intervals."""
    rows = _log_evaluation(spark, sf_dir).withColumns({
        "search_success": F.col("complete_recall"), "tool_calls": F.lit(1), "text_read_tokens": F.col("tokens_read"), "evidence_gain_step2": F.lit(None).cast("int"), "stop_accuracy": F.lit(None).cast("int"),
    })
    found = metrics.summary_with_intervals(rows)
    shown = ("evidence_recall", "evidence_recall_low", "evidence_recall_high", "complete_recall_low", "complete_recall_high")
    return found.select("method", F.col("k").cast("long"), *[F.round(c, 6).alias(c) for c in shown])


# ---- repair, freezing, private keys ---------------------------------------------------------------------------------


def _shortened(prompts: list[str]) -> list[str]:
    """A stand-in for a model: at attempt n the first 6 n words of the text, as a question."""
    import json

    out = []
    for prompt in prompts:
        attempt, text = prompt.split("|", 1)
        out.append(json.dumps({"question": " ".join([w for w in text.split(" ") if w][: 6 * int(attempt)]) + "?"}))
    return out


def _even(prompts: list[str]) -> list[str]:
    """A stand-in for a verifier: grounded is what has an even number of words."""
    import json

    return [json.dumps({"answerable": True, "single_answer": True, "grounded": len([w for w in p.split(" ") if w]) % 2 == 0, "reason": "odd"}) for p in prompts]


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM conversations WHERE role = 'user'),
  a AS (SELECT conv_id, turn, n, array_to_string(list_slice(w, 1, 6 * n), ' ') || '?' AS q FROM t CROSS JOIN (SELECT unnest([1, 2, 3]) AS n)),
  c AS (SELECT *, {_basic_sql('q')} AS issues, len(list_filter(string_split(trim(q, ' '), ' '), lambda w: w <> '')) % 2 = 0 AS fair FROM a),
  b AS (SELECT conv_id, turn, min(n) FILTER (len(issues) = 0 AND fair) AS first FROM c GROUP BY ALL)
  SELECT conv_id, turn, CASE WHEN first IS NULL THEN 'needs_review' ELSE 'accepted' END AS status, CAST(coalesce(first, 3) AS INT) AS attempts, md5(trim(q, ' ')) AS question, array_to_string(issues, '|') AS issues
  FROM b JOIN c USING (conv_id, turn) WHERE n = coalesce(first, 3)""")
def repair_run(spark, sf_dir):
    """Turns of users made into questions by a stand-in client, in three attempts at most."""
    rows = src.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'")
    rows = rows.select(F.concat_ws("_", "conv_id", F.col("turn")).alias("question_id"), "conv_id", "turn", F.lit("").alias("question"), "text")
    task = repair.Task(lambda r: questions.basic(F.col("question")), F.concat_ws("|", F.col("attempt").cast("string"), "text"), F.col("question"))
    found = repair.repair(rows, task, _shortened, _even, _folder(spark, "repair"))
    return found.select("conv_id", "turn", "status", "attempts", F.md5("question").alias("question"), _joined(F.col("issues")).alias("issues"))


def _digest_sql(table: str, columns: list[str]) -> str:
    shown = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE '=' || {c} END" for c in sorted(columns))
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), {shown})), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM {table}"


@query(f"{_digest_sql('benchmark', ['item_id', 'text'])} UNION ALL {_digest_sql('conversations', ['conv_id', 'turn', 'role', 'text'])} UNION ALL {_digest_sql('labels', ['doc_id', 'quality', 'toxic'])}")
def frozen_tables(spark, sf_dir):
    """What a freeze of three tables lists, read from its manifest."""
    of = {"benchmark": ("item_id", "text"), "conversations": ("conv_id", "turn", "role", "text"), "labels": ("doc_id", "quality", "toxic")}
    path = _folder(spark, "frozen")
    freeze.freeze({n: src.table(spark, sf_dir, n, *c) for n, c in of.items()}, path, {"source": "tables"})
    return freeze.listing(spark, path)


@query(f"""WITH {_QUESTIONS}, g AS (SELECT question_id, doc_id FROM questions JOIN documents ON contains(text, question)), l AS (SELECT question_id, list_sort(list(DISTINCT CAST(doc_id AS VARCHAR))) AS g FROM g GROUP BY question_id)
  SELECT question_id, task_type, question, CAST(coalesce(len(g), 0) AS INT) AS n_gold, coalesce(array_to_string(g, '|'), '') AS gold_documents, array_to_string(list_filter([CASE WHEN trim(question) = '' THEN 'empty_question' END, CASE WHEN g IS NULL THEN 'no_gold_document' END], lambda x: x IS NOT NULL), '|') AS problems
  FROM questions LEFT JOIN l USING (question_id)""")
def data_check(spark, sf_dir):
    asked = src.benchmark_as_questions(spark, sf_dir)
    return freeze.data_check(asked, src.gold_by_containment(asked, src.documents_as_corpus(spark, sf_dir)))


@query("""WITH t AS (SELECT conv_id, list({'role': role, 'answer': CASE WHEN role = 'assistant' THEN turn END, 'note': CASE WHEN role = 'system' THEN {'gold_documents': [turn]} END} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
  j AS (SELECT conv_id, to_json({'conv_id': conv_id, 'rounds': [turns]}) AS payload FROM t)
  SELECT conv_id, substr(x.fullkey, 2) AS path, x.key AS key FROM j, json_tree(j.payload) x WHERE x.key IN ('answer', 'gold_documents') AND x.type <> 'NULL'""")
def private_key_paths(spark, sf_dir):
    """Where in nested logs of conversations private keys lie."""
    rows = src.table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    note = F.when(F.col("role") == "system", F.struct(F.array("turn").alias("gold_documents")))
    turn = F.struct("turn", "role", F.when(F.col("role") == "assistant", F.col("turn")).alias("answer"), note.alias("note"))
    logs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # the turns of one conversation
    payload = F.to_json(F.struct("conv_id", F.array("turns").alias("rounds")))
    return dataset.private_findings(logs.select("conv_id", payload.alias("payload")), "payload", "conv_id")


# ---- SQL functions, samples of any shape ----------------------------------------------------------------------------


@query(f"""SELECT item_id, {_norm('text')} AS normal, array_to_string({_toks('text')}, '|') AS tokens, array_to_string({_kws('text', 8)}, '|') AS keywords, array_to_string({_terms_sql('text', 18)}, '|') AS terms,
  array_to_string({_ents('text')}, '|') AS entities, array_to_string({_nums('text')}, '|') AS numbers FROM benchmark""")
def sql_functions(spark, sf_dir):
    """The features of items, asked for in SQL."""
    sql_text.register(spark)
    src.table(spark, sf_dir, "benchmark").createOrReplaceTempView("_items")
    return spark.sql("""SELECT item_id, normalize_text(text) AS normal, array_join(normal_tokens(text), '|') AS tokens, array_join(keywords(text, 8), '|') AS keywords, array_join(query_terms(text, 18), '|') AS terms,
        array_join(simple_entities(text), '|') AS entities, array_join(numbers_and_dates(text), '|') AS numbers FROM _items""")


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(st AS BIGINT) AS sentence_start, CAST(en AS BIGINT) AS sentence_end, md5(body) AS body FROM chunks")
def sql_chunks(spark, sf_dir):
    """The chunks of all documents, by the table function."""
    sql_text.register(spark)
    src.documents_as_corpus(spark, sf_dir).select("doc_id", "sentences").createOrReplaceTempView("_texts")
    return spark.sql("SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(sentence_start AS BIGINT) AS sentence_start, CAST(sentence_end AS BIGINT) AS sentence_end, md5(body) AS body FROM _texts, LATERAL chunks(sentences)")


@query(f"WITH {_SAMPLES} SELECT sample_id, title, sent_id, md5(text) AS text FROM facts")
def samples_any_shape(spark, sf_dir):
    """Nested samples written as JSON lines in three shapes, a third each, and read again."""
    rows = _nested_samples(spark, sf_dir)
    zipped = lambda c, a, b: F.arrays_zip(F.col(f"{c}.{a}").alias(a), F.col(f"{c}.{b}").alias(b))
    pairs = lambda c, a, b: F.transform(zipped(c, a, b), lambda p: F.concat(F.lit("["), F.to_json(F.array(p[a])).substr(F.lit(2), F.length(F.to_json(F.array(p[a]))) - 2), F.lit(", "), _json(p[b]), F.lit("]")))
    line = lambda context, facts, key: F.concat(F.lit(f'{{"{key}": "'), "id", F.lit('", "context": '), context, F.lit(', "supporting_facts": '), facts, F.lit("}"))
    as_is = line(F.to_json("context"), F.to_json("supporting_facts"), "id")
    objects = line(F.to_json(zipped("context", "title", "sentences")), F.to_json(zipped("supporting_facts", "title", "sent_id")), "_id")
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    paired = line(listed(pairs("context", "title", "sentences")), listed(pairs("supporting_facts", "title", "sent_id")), "qid")
    shape = F.pmod(F.xxhash64("id"), F.lit(3))
    path = _folder(spark, "samples")
    rows.select(F.when(shape == 0, as_is).when(shape == 1, objects).otherwise(paired).alias("value")).write.text(path)
    return src.supporting_sentences(src.samples_of_any_shape(spark.read.text(path))).select("sample_id", "title", "sent_id", F.md5("text").alias("text"))


def _json(value):
    """JSON of a number or of an array of texts."""
    inner = F.to_json(F.array(value))
    return inner.substr(F.lit(2), F.length(inner) - 2)


# ---- builders, streams ----------------------------------------------------------------------------------------------

_PICKED = f"""{_CORPUS}, c AS (SELECT doc_id, title AS source, len({_nums("title || '. ' || text")}) AS n_numbers, len({_ents('title')}) AS n_names FROM corpus WHERE title <> ''),
  once1 AS (SELECT source, min(doc_id) AS doc_id FROM c WHERE n_numbers >= 3 GROUP BY source), s1 AS (SELECT 'exact' AS stage, row_number() OVER (ORDER BY doc_id) AS place, source, doc_id FROM once1 QUALIFY place <= 20),
  once2 AS (SELECT source, min(doc_id) AS doc_id FROM c WHERE n_names >= 1 AND source NOT IN (SELECT source FROM s1) GROUP BY source), s2 AS (SELECT 'multi_hop' AS stage, row_number() OVER (ORDER BY doc_id) AS place, source, doc_id FROM once2 QUALIFY place <= 25),
  once3 AS (SELECT source, min(doc_id) AS doc_id FROM c WHERE source NOT IN (SELECT source FROM s1 UNION SELECT source FROM s2) GROUP BY source), s3 AS (SELECT 'semantic' AS stage, row_number() OVER (ORDER BY doc_id) AS place, source, doc_id FROM once3 QUALIFY place <= 30),
  picked AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""
_STAGE_QUOTAS = {"exact": 20, "multi_hop": 25, "semantic": 30}


def _picked(spark, sf_dir) -> DataFrame:
    """Documents for three kinds of question: with numbers, with names in the title, and any; a title is a source."""
    rows = src.documents_as_corpus(spark, sf_dir).filter("title <> ''")
    numbers = F.size(tx.numbers_and_dates(F.concat("title", F.lit(". "), "full_text")))
    of = lambda rule: rows.filter(rule).select(F.col("title").alias("source"), "doc_id")
    kinds = {"exact": of(numbers >= 3), "multi_hop": of(F.size(tx.entities(F.col("title"))) >= 1), "semantic": of(F.lit(True))}
    return builders.in_stages([(n, kinds[n], q) for n, q in _STAGE_QUOTAS.items()], "source", ["doc_id"])


@query(f"WITH {_PICKED} SELECT stage, CAST(place AS INT) AS place, source, doc_id FROM picked")
def staged_selection(spark, sf_dir):
    return _picked(spark, sf_dir).select("stage", "place", "source", "doc_id")


@query(f"""WITH {_PICKED}, o AS (SELECT doc_id FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM picked) ORDER BY md5('42:' || doc_id), doc_id LIMIT 300 - (SELECT count(*) FROM picked))
  SELECT doc_id, 'chosen' AS role FROM picked UNION ALL SELECT doc_id, 'fill' FROM o""")
def filled_corpus(spark, sf_dir):
    """A corpus of three hundred documents around those that were picked."""
    return builders.filled(src.table(spark, sf_dir, "documents", "doc_id"), _picked(spark, sf_dir), 300).select("doc_id", "role")


@query(f"""WITH {_PICKED}, w AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {q})" for n, q in _STAGE_QUOTAS.items())}) AS v(stage, wanted))
  SELECT w.stage, wanted, count(source) AS found, count(DISTINCT source) AS sources, CASE WHEN count(source) < wanted THEN 'too_few' ELSE '' END AS problem FROM w LEFT JOIN picked USING (stage) GROUP BY w.stage, wanted""")
def quota_check(spark, sf_dir):
    return builders.quota_problems(_picked(spark, sf_dir), _STAGE_QUOTAS, "source")


@query(f"""WITH {_LOG}, one AS (SELECT question_id, doc_id, title, min(rank) AS rank FROM log WHERE method = 'click' AND rank <= 10 GROUP BY ALL), two AS (SELECT question_id, doc_id, title, min(rank) AS rank FROM log WHERE method = 'view' AND rank <= 10 GROUP BY ALL),
  q AS (SELECT question_id, max(score) < 150 AS wants, min(rank) AS protect FROM log WHERE method = 'click' GROUP BY question_id), t AS (SELECT DISTINCT question_id FROM two), d AS (SELECT q.*, wants AND t.question_id IS NOT NULL AS both_there FROM q LEFT JOIN t USING (question_id)),
  w AS (SELECT *, 0 AS turn FROM one UNION ALL SELECT *, 1 FROM two),
  m AS (SELECT question_id, doc_id, sum(CASE WHEN turn = 0 THEN 1.2 ELSE 1.35 END / (60 + rank))::DOUBLE AS score, min(title) AS title, min(CASE WHEN turn = 0 THEN rank END) AS fr, any_value(protect) AS p FROM w JOIN d USING (question_id) WHERE both_there GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN fr <= p THEN 0 ELSE 1 END, CASE WHEN fr <= p THEN fr ELSE 0 END, round(score, 12) DESC, title, doc_id) AS rank FROM m)
  SELECT question_id, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS doc_id, title, round(score, 6) AS score, 2 AS rounds FROM r WHERE rank <= 5
  UNION ALL SELECT question_id, CAST(rank AS INT), CAST(doc_id AS VARCHAR), title, round(1.0 / (60 + rank), 6)::DOUBLE, 1 FROM one JOIN d USING (question_id) WHERE NOT both_there AND NOT wants AND rank <= 5""")
def streaming_answers(spark, sf_dir):
    """Two lists of each user as events of a stream: clicks first, views where the best click is worth less than 150."""
    rows = _ranked_log(spark, sf_dir).filter("method in ('click', 'view')")
    best = rows.filter("rank <= 10").groupBy("question_id", "method", "doc_id", "title").agg(F.min("rank").alias("rank"))
    lists = best.groupBy("question_id", "method").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), "title"))).alias("documents"))  # ten each
    worth = rows.filter("method = 'click'").groupBy("question_id").agg((F.max("score") < 150).alias("wants_second"))
    events = lists.join(worth, "question_id").select(
        "question_id", F.when(F.col("method") == "click", 0).otherwise(1).alias("turn"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), "wants_second", F.lit(1.2).alias("first_weight"),
        F.lit(1.35).alias("second_weight"), F.lit(1).alias("protect"), "documents",
    )
    source, out, check = (_folder(spark, n) for n in ("events", "answers", "answers-check"))
    events.write.parquet(source)
    found = two_stage.run_available(spark.readStream.schema(events.schema).parquet(source), out, check)
    return found.select("question_id", "rank", "doc_id", "title", F.round("score", 6).alias("score"), "rounds")


# ---- checks of questions --------------------------------------------------------------------------------------------


def _cw(x: str) -> str:
    return f"list_distinct(list_filter({_toks(x)}, lambda t: len(t) > 2 AND NOT list_contains({_STOP}, t)))"


def _within(haystack: str, needle: str) -> str:
    return f"({_norm(needle)} <> '' AND contains({_norm(haystack)}, {_norm(needle)}))"


def _says(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{t}')" if " " in t else f"regexp_matches(lower({text}), '\\b{t}\\b')" for t in terms) + ")"


def _codes_sql(checks: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sorted(checks.items())) + "], lambda c: c IS NOT NULL)"


def _shown(*lists: str) -> str:
    both = lists[0]
    for more in lists[1:]:
        both = f"list_concat({both}, {more})"
    return f"array_to_string(list_sort(list_distinct({both})), '|')"


_FIRST_WORDS = "array_to_string(list_slice(list_filter(string_split(sentences[1], ' '), lambda w: w <> ''), 1, {0}), ' ')"
_SEMANTIC = f"""{_CORPUS}, r AS (SELECT doc_id, 'lead' AS kind, {_FIRST_WORDS.format(10)} || '?' AS q, title, sentences[1] AS s FROM corpus WHERE len(sentences) > 0 UNION ALL SELECT doc_id, 'title', 'What is the ' || title || '?', title, sentences[1] FROM corpus WHERE len(sentences) > 0),
  f AS (SELECT *, {_norm('q')} AS asked, {_norm('title')} AS tn, {_cw('q')} AS qw, {_cw('s')} AS sw, {_cw('title')} AS tw FROM r)"""


def _lead(words: int):
    return F.array_join(F.slice(F.filter(F.split(F.get("sentences", F.lit(0)), " "), lambda w: w != ""), 1, words), " ")


@query(f"""WITH {_SEMANTIC} SELECT doc_id, kind, {_shown(_basic_sql('q'), _codes_sql({
    'semantic_question_uses_file_or_rewrite_language': _says('q', questions.FACT_FORBIDDEN),
    'semantic_question_is_title_definition': "tn <> '' AND (" + " OR ".join(f"starts_with(asked, '{d}' || tn)" for d in questions.DEFINITIONS) + ") AND len(list_filter(qw, lambda w: NOT list_contains(tw, w))) <= 1",
    'question_copies_gold_sentence_too_closely': "len(qw) >= 5 AND len(sw) > 0 AND len(list_intersect(qw, sw)) / greatest(len(qw), 1) >= 0.78",
    'question_has_too_little_overlap_with_gold_sentence': "len(qw) >= 5 AND len(sw) > 0 AND len(list_intersect(qw, sw)) / greatest(len(qw), 1) <= 0.10"}))} AS issues FROM f""")
def semantic_issues(spark, sf_dir):
    """Two questions about every document's first sentence: its first words, and what its title is."""
    rows = src.documents_as_corpus(spark, sf_dir).filter(F.size("sentences") > 0)
    of = lambda kind, q: rows.select("doc_id", F.lit(kind).alias("kind"), q.alias("question"), F.col("title").alias("gold_title"), F.get("sentences", F.lit(0)).alias("gold_sentence"))
    every = of("lead", F.concat(_lead(10), F.lit("?"))).union(of("title", F.concat(F.lit("What is the "), "title", F.lit("?"))))
    return every.select("doc_id", "kind", _joined(questions.semantic(every)).alias("issues"))


_EXACT = f"""{_CORPUS}, c AS (SELECT corpus.*, sentences[1] AS s, {_nums('sentences[1]')} AS n, lang FROM corpus JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE len(sentences) > 0),
  r AS (SELECT doc_id, 'title_anchor' AS kind, 'Find the document titled "' || title || '"' AS q, title AS anchor, title, s FROM c UNION ALL SELECT doc_id, 'date_number_lookup', 'Which record mentions ' || n[1] || '?', n[1], title, s FROM c WHERE len(n) > 0
    UNION ALL SELECT doc_id, 'exact_phrase_lookup', 'Find the page that contains "' || {_FIRST_WORDS.format(4)} || '".', {_FIRST_WORDS.format(4)}, title, s FROM c UNION ALL SELECT doc_id, lang, s, title, title, s FROM c),
  f AS (SELECT *, CASE WHEN kind = 'date_number_lookup' AND trim(anchor) <> '' THEN coalesce(list_filter(regexp_extract_all(s, '{questions.DATE}'), lambda d: {_within('d', 'anchor')})[1], trim(anchor)) ELSE trim(anchor) END AS wide FROM r)"""


def _lookups(spark, sf_dir) -> DataFrame:
    """Lookups of four kinds for every document, the last of no kind that is known."""
    docs = src.documents_as_corpus(spark, sf_dir).join(src.table(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id").filter(F.size("sentences") > 0)
    sentence = F.get("sentences", F.lit(0))
    docs = docs.withColumns({"s": sentence, "n": F.get(tx.numbers_and_dates(sentence), F.lit(0)), "lead": _lead(4)})
    of = lambda rows, kind, q, anchor: rows.select("doc_id", kind.alias("subtype"), q.alias("question"), F.col(anchor).alias("anchor_value"), F.col("title").alias("gold_title"), F.col("s").alias("gold_sentence"))
    rows = of(docs, F.lit("title_anchor"), F.concat(F.lit('Find the document titled "'), "title", F.lit('"')), "title")
    rows = rows.union(of(docs.filter("n is not null"), F.lit("date_number_lookup"), F.concat(F.lit("Which record mentions "), "n", F.lit("?")), "n"))
    rows = rows.union(of(docs, F.lit("exact_phrase_lookup"), F.concat(F.lit('Find the page that contains "'), "lead", F.lit('".')), "lead"))
    return rows.union(of(docs, F.col("lang"), F.col("s"), "title"))


@query(f"""WITH {_EXACT} SELECT doc_id, kind, {_shown(_basic_sql('q', True), _codes_sql({
    'boilerplate_evidence_template': "contains(lower(q), 'evidence needed to answer') OR contains(lower(q), 'evidence related to')",
    'missing_file_lookup_language': "NOT (" + " OR ".join(f"contains(lower(q), '{w}')" for w in questions.LOOKUP_WORDS) + ")",
    'missing_required_anchor': f"NOT {_within('q', 'wide')}", 'anchor_not_in_gold_sentence': f"kind <> 'title_anchor' AND anchor <> '' AND NOT {_within('s', 'anchor')}",
    'title_anchor_missing_gold_title': f"kind = 'title_anchor' AND NOT {_within('q', 'title')}", 'non_title_lookup_leaks_gold_title': f"kind IN ('date_number_lookup', 'exact_phrase_lookup') AND {_within('q', 'title')}",
    'exact_phrase_not_quoted': "kind = 'exact_phrase_lookup' AND NOT contains(q, chr(34))"}),
    "CASE WHEN kind NOT IN ('title_anchor', 'date_number_lookup', 'exact_phrase_lookup') THEN ['unknown_exact_subtype:' || kind] ELSE [] END")} AS issues,
  CASE WHEN kind IN ('date_number_lookup', 'exact_phrase_lookup') AND ({_within('anchor', 'title')} OR {_within('wide', 'title')}) THEN 'anchor_leaks_gold_title' ELSE '' END AS preflight FROM f""")
def lookup_issues(spark, sf_dir):
    """Issues of lookups, and of their anchors before a question is made."""
    rows = _lookups(spark, sf_dir)
    return rows.select("doc_id", F.col("subtype").alias("kind"), _joined(questions.exact(rows)).alias("issues"), _joined(questions.preflight(rows)).alias("preflight"))


@query(f"""WITH {_CORPUS}, {_QUESTIONS}, g AS (SELECT question_id, count(*) AS n_docs, count(*) FILTER (trim(title, ' ') <> '') AS n_titles FROM questions JOIN corpus ON contains(text, question) GROUP BY question_id),
  r AS (SELECT question_id, question AS q, coalesce({_kws('question', 1)}[1], '') AS answer, coalesce(n_docs, 0) AS n_docs, coalesce(n_titles, 0) AS n_titles FROM questions LEFT JOIN g USING (question_id))
  SELECT question_id, {_shown(_basic_sql('q'), _codes_sql({
    'multi_hop_requires_exactly_two_gold_documents': 'n_docs <> 2', 'multi_hop_requires_at_least_two_gold_sentences': 'n_titles < 2', 'empty_answer': "trim(answer) = ''",
    'answer_leaked_in_question': f"trim(answer) <> '' AND {_within('q', 'answer')}", 'question_has_weak_relation_signal': "NOT regexp_matches(lower(q), '" + questions.RELATION_WORDS + "')"}))} AS issues FROM r""")
def multi_hop_issues(spark, sf_dir):
    """Items with the documents that hold them as gold, and their most frequent keyword as an answer."""
    asked, corpus = src.benchmark_as_questions(spark, sf_dir), src.documents_as_corpus(spark, sf_dir)
    gold = src.gold_by_containment(asked, corpus).join(corpus.select("doc_id", "title"), "doc_id")
    lists = gold.groupBy("question_id").agg(F.array_join(F.collect_list(F.col("doc_id").cast("string")), "|").alias("gold_doc_ids"), F.array_join(F.collect_list("title"), "||").alias("gold_sentences"))
    rows = asked.join(lists, "question_id", "left").na.fill("", ["gold_doc_ids", "gold_sentences"])
    rows = rows.withColumn("answer", F.coalesce(F.get(tx.keywords(F.col("question"), 1), F.lit(0)), F.lit("")))
    return rows.select("question_id", _joined(questions.multi_hop(rows)).alias("issues"))


# ---- rows of the stages ---------------------------------------------------------------------------------------------


@query(f"""WITH {_PICKED}, r AS (SELECT 'cand_' || stage || '_' || doc_id AS candidate_id, stage, source, doc_id, {_FIRST_WORDS.format(8)} || '?' AS q, sentences[1] AS s, {_kws('sentences[1]', 1)}[1] AS answer, {_nums("title || '. ' || text")}[1] AS anchor
    FROM picked JOIN (SELECT doc_id, title, text, sentences FROM corpus) USING (doc_id) WHERE len(sentences) > 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY candidate_id) AS place FROM r WHERE anchor IS NOT NULL)
  SELECT printf('final_%04d', place) AS question_id, trim(q, ' ') AS question, stage AS task_type, CAST(doc_id AS VARCHAR) AS gold_documents, md5(s) AS gold_sentence, source AS source_id, true AS quality_checked,
  'anchor_value=' || anchor || '|answer=' || coalesce(answer, '') || '|candidate_id=' || candidate_id || '|construction=picked|llm_attempts=|llm_verdict=|requires_manual_review=false|source_sheet=sheet|source_status=accepted|subtype=first|support_titles=' || source || '|verifier_model=' AS metadata FROM n""")
def stage_rows(spark, sf_dir):
    """Picked documents as candidates, their sheet with a question written in where the text has a number, and the questions made of both."""
    docs = src.documents_as_corpus(spark, sf_dir).filter(F.size("sentences") > 0)
    first = F.get("sentences", F.lit(0))
    gold = F.array(F.struct("doc_id", "title", F.lit(0).alias("sent_id"), first.alias("text")))
    anchor = F.get(tx.numbers_and_dates(F.concat("title", F.lit(". "), "full_text")), F.lit(0))
    rows = _picked(spark, sf_dir).join(docs, "doc_id").select(
        F.concat_ws("_", F.lit("cand"), "stage", "doc_id").alias("candidate_id"), F.col("stage").alias("task_type"), F.lit("first").alias("subtype"), F.concat(_lead(8), F.lit("?")).alias("question"), F.col("source").alias("source_id"),
        F.get(tx.keywords(first, 1), F.lit(0)).alias("answer"), gold.alias("gold"), F.create_map(F.lit("anchor_value"), F.coalesce(anchor, F.lit("")), F.lit("requires_manual_review"), F.lit("true")).alias("metadata"),
    )
    pool = stages.pool_rows(rows)
    sheet = stages.sheet_rows(pool)
    worked = sheet.withColumns({"status": F.when(F.col("anchor_value") != "", "accepted").otherwise("todo"), "final_question": F.col("current_question")})
    made = stages.question_rows(stages.accepted(worked, "final_question"), pool, "picked", "sheet", "final")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return made.select("question_id", "question", "task_type", F.array_join("gold_documents", "|").alias("gold_documents"), F.md5(F.get("gold_sentences", F.lit(0))["text"]).alias("gold_sentence"), "source_id", "quality_checked", shown.alias("metadata"))
