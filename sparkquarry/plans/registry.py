"""The retrieval engine's registered queries, each with its SQL twin where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkquarry.functions import text as tx
from sparkquarry.operators import dataset, dense, fts, fusion, graph, metrics, questions, reports, routing, samples, store
from sparkquarry.operators.terms import shared_dir
from sparkquarry.plans import agent, graph_sql
from sparkquarry.sources import corpus as src
from sparkquarry.streaming import scoring

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _joined(c):
    return F.array_join(c, "|")


# ---- SQL pieces -----------------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
_QSTOP = "[" + ", ".join(f"'{w}'" for w in tx.QUERY_STOPWORDS) + "]"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _toks(x: str) -> str:
    return f"list_filter(string_split({_norm(x)}, ' '), lambda t: t <> '')"


def _nums(x: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all({_ascii(x)}, '\b\d{{4}}\b|\b\d+(?:\.\d+)?\b')))"


def _ascii(x: str) -> str:
    """Letters outside ASCII as underscores: word characters that no pattern names."""
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '_', 'g')"


def _ents(x: str) -> str:
    pattern = r"\b(?:[A-Z][a-zA-Z0-9''&.-]+)(?:\s+(?:[A-Z][a-zA-Z0-9''&.-]+|of|the|and|de|la))*"
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({_ascii(x)}, '{pattern}'), lambda e: {_norm('e')}), lambda e: e <> '' AND NOT list_contains({_STOP}, e))))"


def _kws(x: str, n: int) -> str:
    """Keywords of a text by count and first place."""
    kept = f"list_filter({_toks(x)}, lambda t: len(t) > 2 AND NOT list_contains({_STOP}, t))"
    ranked = f"list_sort(list_transform(list_distinct({kept}), lambda t: {{'n': -len(list_filter({kept}, lambda y: y = t)), 'a': list_position({kept}, t), 't': t}}))"
    return f"list_transform(list_slice({ranked}, 1, {n}), lambda e: e.t)"


_CORPUS = """corpus AS (SELECT doc_id, array_to_string(list_slice(list_filter(string_split(string_split(text, chr(10))[1], ' '), lambda w: w <> ''), 1, 5), ' ') AS title,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS sentences, text FROM documents)"""

_QUESTIONS = """questions AS (SELECT item_id AS question_id, text AS question,
  CASE item_id % 3 WHEN 0 THEN 'semantic_fact' WHEN 1 THEN 'multi_hop_relation' ELSE 'exact_file_lookup' END AS task_type FROM benchmark)"""


# ---- text features --------------------------------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "documents", "doc_id", "text")


@query(f"SELECT doc_id, md5({_norm('text')}) AS normal, CAST(len({_toks('text')}) AS BIGINT) AS n FROM documents")
def text_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("normal"), F.size(tx.normal_tokens(F.col("text"))).cast("long").alias("n"))


@query("SELECT doc_id, greatest(1, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS BIGINT)) AS n FROM documents")
def text_token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.token_count(F.col("text")).cast("long").alias("n"))


@query(f"SELECT doc_id, array_to_string({_nums('text')}, '|') AS numbers FROM documents")
def text_numbers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(tx.numbers_and_dates(F.col("text"))).alias("numbers"))


@query(f"SELECT doc_id, array_to_string({_ents('text')}, '|') AS entities FROM documents")
def text_entities(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(tx.entities(F.col("text"))).alias("entities"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '\"([^\"]+)\"', 1), lambda p: trim(p)), '|') AS quotes FROM documents")
def text_quotes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(tx.quoted_phrases(F.col("text"))).alias("quotes"))


@query(f"SELECT item_id, array_to_string({_kws('text', 12)}, '|') AS keywords FROM benchmark")
def text_keywords(spark, sf_dir):
    return src.table(spark, sf_dir, "benchmark").select("item_id", _joined(tx.keywords(F.col("text"), 12)).alias("keywords"))


@query(f"""WITH t AS (SELECT doc_id, unnest({_toks('text')}) AS tok, generate_subscripts({_toks('text')}, 1) AS pos FROM documents),
  c AS (SELECT doc_id, tok, count(*) AS n, min(pos) AS p FROM t WHERE len(tok) > 2 AND NOT list_contains({_STOP}, tok) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS k FROM c),
  l AS (SELECT doc_id, string_agg(tok, '|' ORDER BY k) AS keywords FROM r WHERE k <= 96 GROUP BY doc_id)
  SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN l USING (doc_id)""")
def document_keywords(spark, sf_dir):
    from sparkquarry.operators.terms import document_keywords as build

    return build(_docs(spark, sf_dir), F.col("text"), 96).select("doc_id", _joined(F.col("keywords")).alias("keywords"))


def _terms_sql(x: str, n: int) -> str:
    both = f"list_concat({_kws(x, 2 * n)}, {_toks(x)})"
    kept = f"list_filter({both}, lambda t: NOT list_contains({_QSTOP}, t) AND (len(t) > 2 OR regexp_full_match(t, '[0-9]+')))"
    return f"list_slice(list_transform(list_sort(list_transform(list_distinct({kept}), lambda t: {{'a': list_position({kept}, t), 't': t}})), lambda e: e.t), 1, {n})"


@query(f"SELECT item_id, array_to_string({_terms_sql('text', 18)}, '|') AS terms FROM benchmark")
def query_terms(spark, sf_dir):
    return src.table(spark, sf_dir, "benchmark").select("item_id", _joined(tx.query_terms(F.col("text"))).alias("terms"))


_CUES = ", ".join(f"CASE WHEN list_has_any({_toks('text')}, [{', '.join(repr(w) for w in words)}]) THEN '{name}' END" for name, words in sorted(tx.RELATIONS.items()))


@query(f"SELECT doc_id, array_to_string(list_filter([{_CUES}], lambda c: c IS NOT NULL), '|') AS cues FROM documents")
def relation_cues(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(tx.relation_cues(tx.normal_tokens(F.col("text")))).alias("cues"))


@query("""SELECT p_partkey, 'doc_' || substr(CASE WHEN s = '' THEN 'untitled' ELSE s END, 1, 48) || '_' || substr(sha1(p_name), 1, 10) AS stable_id
  FROM (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)""")
def stable_ids(spark, sf_dir):
    return src.table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", tx.stable_doc_id(F.col("p_name")).alias("stable_id"))


@query("""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda t: t <> '') AS p FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(p) > 100 THEN array_to_string(list_slice(p, 1, 100), ' ') ELSE text END AS s FROM w)
  SELECT doc_id, md5(CASE WHEN length(s) > 400 THEN regexp_replace(substr(s, 1, 400), '\\s\\S*$', '') ELSE s END) AS short FROM s""")
def truncate_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.truncate_words(F.col("text"), 100)).alias("short"))


# ---- indexes, built once a session and source -----------------------------------------------------------------------


def _fts_index(spark: SparkSession, sf_dir: str) -> fts.Index:
    def made():
        return fts.build(src.documents_as_corpus(spark, sf_dir)).tables(), {}

    return fts.Index(**store.built_once(spark, "fts-index", sf_dir, made, None, f"{sf_dir}/documents.parquet")[0])


def _graph_index(spark: SparkSession, sf_dir: str) -> graph.Graph:
    def made():
        built = graph.build(src.documents_as_corpus(spark, sf_dir))
        return built.tables(), {"n_docs": built.n_docs}

    return graph.from_tables(*store.built_once(spark, "graph-index", sf_dir, made, table=f"{sf_dir}/documents.parquet"))


def _dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents by the encoder without a model."""

    def made():
        rows = src.documents_as_corpus(spark, sf_dir).select("doc_id", tx.document_text(F.col("title"), F.col("full_text")).alias("text"))
        return {"vectors": dense.hashed(rows, "doc_id", "text")}, {"encoder": "hashed", "components": dense.HASHED}

    return store.built_once(spark, "dense-docs", sf_dir, made, table=f"{sf_dir}/documents.parquet")[0]["vectors"]


# ---- full-text index and search -------------------------------------------------------------------------------------

_CHUNKS = f"""{_CORPUS}, starts AS (SELECT doc_id, title, sentences, len(sentences) AS n, unnest(generate_series(0, len(sentences) - 1, 2)) AS st FROM corpus WHERE len(sentences) > 0),
  chunks AS (SELECT doc_id, title, st, least(st + 3, n) - 1 AS en, st // 2 AS chunk_no, array_to_string(list_slice(sentences, st + 1, st + 3), ' ') AS body FROM starts WHERE st = 0 OR st + 1 < n)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(st AS BIGINT) AS sentence_start, CAST(en AS BIGINT) AS sentence_end, md5(body) AS body FROM chunks")
def fts_chunks(spark, sf_dir):
    rows = fts.chunks(src.documents_as_corpus(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk_no").cast("long"), F.col("sentence_start").cast("long"), F.col("sentence_end").cast("long"), F.md5("body").alias("body"))


_WHOLE = "title || '. ' || body"
_ITOK = "regexp_extract_all(translate(lower({0}), '" + fts.ACCENTED + "', '" + fts.PLAIN + "'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
_FIELDS = f"""{_CHUNKS}, fields AS (SELECT doc_id, chunk_no, {_ITOK.format('title')} AS t, {_ITOK.format('body')} AS b,
   {_ITOK.format(f"array_to_string({_ents(_WHOLE)}, ' ')")} AS e, {_ITOK.format(f"array_to_string({_nums(_WHOLE)}, ' ')")} AS m FROM chunks),
  post AS (SELECT term, doc_id, chunk_no, sum(w) AS wtf FROM (
    SELECT unnest(t) AS term, doc_id, chunk_no, 6.0::DOUBLE AS w FROM fields UNION ALL SELECT unnest(b), doc_id, chunk_no, 1.0 FROM fields
    UNION ALL SELECT unnest(e), doc_id, chunk_no, 2.0 FROM fields UNION ALL SELECT unnest(m), doc_id, chunk_no, 3.0 FROM fields) GROUP BY ALL)"""


@query(f"WITH {_FIELDS} SELECT term, count(*) AS n_chunks, sum(wtf) AS weight FROM post GROUP BY term")
def fts_term_stats(spark, sf_dir):
    return fts.flat(_fts_index(spark, sf_dir).postings).groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("wtf").alias("weight"))


@query(f"""WITH {_FIELDS} SELECT (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM fields) AS chunks, (SELECT round(avg(len(t) + len(b) + len(e) + len(m)), 6) FROM fields) AS mean_tokens,
  (SELECT count(*) FROM corpus) AS documents""")
def fts_index_counts(spark, sf_dir):
    """Sizes of the full-text index; the first use in a session builds it."""
    index = _fts_index(spark, sf_dir)
    stats = index.stats.select(F.col("n_chunks").alias("chunks"), F.round("mean", 6).alias("mean_tokens"))
    counts = index.postings.agg(F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0)).alias("postings")).join(index.docs.agg(F.count("*").alias("documents")))
    return counts.join(stats).select("postings", "chunks", "mean_tokens", "documents")  # one row each


_SIZES = "size AS (SELECT doc_id, chunk_no, len(t) + len(b) + len(e) + len(m) AS l FROM fields), st AS (SELECT count(*) AS n, avg(l) AS mean FROM size), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"


def _bm25_sql(asked: str, p: str = "") -> str:
    """Ranked chunks ``{p}hits`` of the questions in ``asked``."""
    return f"""{p}asked AS (SELECT question_id, unnest({_terms_sql('question', 18)}) AS term FROM {asked}),
  {p}part AS (SELECT question_id, doc_id, chunk_no, (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * l / mean)) AS s
    FROM {p}asked JOIN post USING (term) JOIN df USING (term) JOIN size USING (doc_id, chunk_no) CROSS JOIN st),
  {p}bm AS (SELECT question_id, doc_id, chunk_no, -sum(s) AS bm25 FROM {p}part GROUP BY ALL),
  {p}hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(bm25, 9), doc_id, chunk_no) AS chunk_rank FROM {p}bm)"""


_BM25 = f"{_FIELDS}, {_QUESTIONS}, {_SIZES}, {_bm25_sql('questions')}"


@query(f"WITH {_BM25} SELECT question_id, doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, round(bm25, 6) AS bm25, CAST(chunk_rank AS BIGINT) AS chunk_rank FROM hits WHERE chunk_rank <= 400")
def fts_bm25_hits(spark, sf_dir):
    hits = fts.chunk_hits(src.benchmark_as_questions(spark, sf_dir), _fts_index(spark, sf_dir))
    return hits.select("question_id", "doc_id", F.col("chunk_no").cast("long"), F.round("bm25", 6).alias("bm25"), F.col("chunk_rank").cast("long"))


def _fts_sql(asked: str, p: str = "") -> str:
    """Ranked documents ``{p}rk``, behind ``_bm25_sql``."""
    return f"""{p}best AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY chunk_rank) AS n FROM {p}hits WHERE chunk_rank <= 400),
  {p}ds AS (SELECT question_id, doc_id, max(1 / log2(chunk_rank + 1.0)) + 0.20 * sum(CASE WHEN n > 1 THEN 1 / log2(chunk_rank + 1.0) ELSE 0 END) AS base FROM {p}best WHERE n <= 3 GROUP BY ALL),
  {p}qf AS (SELECT question_id, {_norm('question')} AS qn, {_terms_sql('question', 18)} AS terms, {_nums('question')} AS qnum,
    list_filter(list_transform(regexp_extract_all(question, '"([^"]+)"', 1), lambda p: {_norm('p')}), lambda p: p <> '') AS ph FROM {asked}),
  {p}dfe AS (SELECT doc_id, title, {_norm('title')} AS tn, {_norm('text')} AS xn, list_distinct({_toks('title')}) AS tt, {_nums("title || '. ' || text")} AS dnum FROM corpus),
  {p}ex0 AS (SELECT question_id, doc_id, tn <> '' AND contains(qn, tn) AS tm, len(list_intersect(tt, terms)) / greatest(len(tt), 1) AS ov, len(list_filter(ph, lambda p: contains(tn, p))) AS et,
    len(list_filter(ph, lambda p: contains(xn, p))) AS pt, len(list_intersect(qnum, dnum)) AS nm FROM {p}qf CROSS JOIN {p}dfe),
  {p}ex AS (SELECT * FROM {p}ex0 WHERE tm OR et > 0 OR pt > 0 OR nm > 0 OR ov >= 0.5),
  {p}sc AS (SELECT question_id, doc_id, coalesce(base, 0) + CASE WHEN tm THEN 0.30 ELSE 0 END + 0.20 * coalesce(ov, 0) + 0.75 * coalesce(et, 0) + 0.20 * coalesce(pt, 0) + 0.10 * coalesce(nm, 0) AS score
    FROM {p}ds FULL JOIN {p}ex USING (question_id, doc_id)),
  {p}rk AS (SELECT question_id, doc_id, title, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, title, doc_id) AS rank FROM {p}sc JOIN corpus USING (doc_id))"""


_FTS = f"{_BM25}, {_fts_sql('questions')}"


@query(f"WITH {_FTS} SELECT question_id, CAST(rank AS BIGINT) AS rank, doc_id, title, round(score, 6) AS score FROM rk WHERE rank <= 5")
def fts_search(spark, sf_dir):
    rows = fts.search(src.benchmark_as_questions(spark, sf_dir), _fts_index(spark, sf_dir))
    return rows.select("question_id", F.col("rank").cast("long"), "doc_id", "title", F.round("score", 6).alias("score"))


_GOLD = f"{_QUESTIONS}, gold AS (SELECT question_id, doc_id FROM questions JOIN documents ON contains(text, question))"


@query(f"WITH {_GOLD} SELECT question_id, doc_id FROM gold")
def gold_containment(spark, sf_dir):
    return src.gold_by_containment(src.benchmark_as_questions(spark, sf_dir), src.documents_as_corpus(spark, sf_dir))


# The first end-to-end plan: index, search, evaluation.
_EVAL_FTS = f"""{_FTS}, g AS (SELECT question_id, doc_id FROM questions q JOIN documents d ON contains(d.text, q.question)),
  gc AS (SELECT question_id, count(*) AS n FROM g GROUP BY ALL), ks AS (SELECT unnest([1, 3, 5]) AS k),
  e AS (SELECT q.question_id, q.task_type, k, coalesce(gc.n, 0) AS gold_count, count(g.doc_id) AS matched, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS first
    FROM questions q JOIN rk ON rk.question_id = q.question_id CROSS JOIN ks LEFT JOIN gc ON gc.question_id = q.question_id
    LEFT JOIN g ON g.question_id = q.question_id AND g.doc_id = rk.doc_id WHERE rank <= k GROUP BY ALL)"""


@query(f"""WITH {_EVAL_FTS} SELECT question_id, task_type, CAST(k AS BIGINT) AS k, CAST(gold_count AS BIGINT) AS gold_count, CAST(matched AS BIGINT) AS matched,
  round(CASE WHEN gold_count > 0 THEN matched / gold_count ELSE 0 END, 6) AS evidence_recall, CASE WHEN gold_count > 0 AND matched = gold_count THEN 1.0::DOUBLE ELSE 0.0 END AS complete_recall,
  round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS mrr FROM e""")
def fts_evaluation(spark, sf_dir):
    questions, corpus = src.benchmark_as_questions(spark, sf_dir), src.documents_as_corpus(spark, sf_dir)
    found = fts.search(questions, _fts_index(spark, sf_dir)).withColumns({"method": F.lit("file_fts"), "latency_ms": F.lit(0.0)})
    rows = metrics.evaluate(found, src.gold_by_containment(questions, corpus), questions)
    return rows.select("question_id", "task_type", *[F.col(c).cast("long") for c in ("k", "gold_count", "matched")], *[F.round(c, 6).alias(c) for c in ("evidence_recall", "complete_recall", "mrr")])


# ---- dense ----------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 25 = 0),
  s AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(qe, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS score FROM q CROSS JOIN embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
  SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def dense_top_k(spark, sf_dir):
    vectors = src.table(spark, sf_dir, "embeddings")
    queries = vectors.filter(F.col("vec_id") % 25 == 0).select(F.col("vec_id").alias("query_id"), "embedding")  # the question set
    return dense.top_k(queries, vectors).select("query_id", F.col("rank").cast("long"), "vec_id", F.round("score", 6).alias("score"))


# ---- graph ----------------------------------------------------------------------------------------------------------

_GRAPH = f"""{_CORPUS}, sents AS (SELECT doc_id, unnest(CASE WHEN len(sentences) > 0 THEN sentences ELSE [text] END) AS s FROM corpus),
  de AS (SELECT doc_id, unnest(list_concat(list_concat({_ents("title || '. ' || text")}, [{_norm('title')}]), list_concat({_kws('title', 12)}, {_nums("title || '. ' || text")}))) AS entity FROM corpus
    UNION SELECT doc_id, unnest(list_concat(list_filter({_ents('s')}, lambda e: NOT regexp_full_match(e, '[0-9]+')), {_nums('s')})) FROM sents),
  doc_entity AS (SELECT DISTINCT doc_id, entity FROM de WHERE len(entity) >= 3), nd AS (SELECT count(*) AS n FROM documents)"""


@query(f"WITH {_GRAPH} SELECT entity, count(*) AS degree, round(ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0, 6) AS idf FROM doc_entity CROSS JOIN nd GROUP BY entity")
def graph_entities(spark, sf_dir):
    ready = store.is_built(spark, "graph-index", sf_dir, f"{sf_dir}/documents.parquet")
    rows = _graph_index(spark, sf_dir).entities if ready else graph.entities(src.documents_as_corpus(spark, sf_dir))
    return rows.select("entity", "degree", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_CORPUS}, d AS (SELECT doc_id, {_norm('title')} AS tn, {_norm('text')} AS xn FROM corpus),
  t AS (SELECT tn, min(doc_id) AS target FROM d WHERE len(tn) >= 4 GROUP BY tn),
  m AS (SELECT d.doc_id, target, row_number() OVER (PARTITION BY d.doc_id ORDER BY len(string_split(t.tn, ' ')) DESC, t.tn, CAST(target AS VARCHAR)) AS n FROM d JOIN t ON contains(xn, t.tn) AND target <> d.doc_id)
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(target AS VARCHAR) AS target FROM m WHERE n <= 6""")
def graph_title_links(spark, sf_dir):
    return graph.title_links(src.documents_as_corpus(spark, sf_dir))


@query(f"""WITH {_GRAPH}, deg AS (SELECT entity, count(*) AS degree FROM doc_entity GROUP BY entity),
  sent_edges AS (SELECT len(list_distinct(list_filter(list_concat(list_filter({_ents('s')}, lambda e: NOT regexp_full_match(e, '[0-9]+')), {_nums('s')}), lambda e: len(e) >= 3))) AS n FROM sents),
  sent_rels AS (SELECT list_filter([{_CUES.replace(_toks('text'), _toks('s'))}], lambda c: c IS NOT NULL) AS r FROM sents),
  dn AS (SELECT doc_id, {_norm('title')} AS tn, {_norm('text')} AS xn FROM corpus), tt AS (SELECT tn, min(doc_id) AS target FROM dn WHERE len(tn) >= 4 GROUP BY tn),
  ln AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tt.tn) AS k FROM dn JOIN tt ON contains(xn, tt.tn) AND target <> doc_id)
  SELECT *, document_entity_edges + sentence_entity_edges + sentences + title_links + relation_sentence_edges AS edges, round(document_entity_edges / documents, 6) AS mean_document_entities FROM (
  SELECT (SELECT count(*) FROM corpus) AS documents, (SELECT count(*) FROM sents) AS sentences, (SELECT CAST(sum(n) AS BIGINT) FROM sent_edges) AS sentence_entity_edges, (SELECT count(*) FROM deg) AS entities,
  (SELECT CAST(sum(degree) AS BIGINT) FROM deg) AS document_entity_edges, (SELECT max(degree) FROM deg) AS max_entity_degree, (SELECT round(avg(degree), 6) FROM deg) AS mean_entity_degree,
  (SELECT count(*) FROM ln WHERE k <= 6) AS title_links, (SELECT count(DISTINCT doc_id) FROM ln) AS documents_with_links, 13 AS relations, (SELECT CAST(sum(len(r)) AS BIGINT) FROM sent_rels) AS relation_sentence_edges)""")
def graph_statistics(spark, sf_dir):
    means = {c: F.round(c, 6) for c in ("mean_entity_degree", "mean_document_entities")}
    return graph.graph_stats(_graph_index(spark, sf_dir)).withColumns(means)


_GRAPH_INDEX = graph_sql.index(_CORPUS, _norm, _toks, _nums, _ents, _kws, _STOP)
_GRAPH_SEARCH = f"{_GRAPH_INDEX}, {_QUESTIONS}, {graph_sql.search('questions', 'g_', _norm, _nums, _ents, _kws, _toks)}"


@query(f"""WITH {_GRAPH_SEARCH} SELECT question_id, CAST(rank AS BIGINT) AS rank, doc_id, title, round(r.score, 6) AS score, n_tokens AS tokens_read, CASE tier WHEN 0 THEN 'graph_path' ELSE 'query_graph_fallback' END AS source,
  CAST(pr AS BIGINT) AS path_rank, array_to_string(nodes, ' > ') AS path, array_to_string(sup, ' > ') AS support, array_to_string(docs, '|') AS path_docs, array_to_string(es, '|') AS entities, array_to_string(rs, '|') AS relations
  FROM g_r r LEFT JOIN g_v v USING (question_id, pr)""")
def graph_search(spark, sf_dir):
    """Documents with the best path to each: its nodes, the kinds of its edges, and what lies on it."""
    rows = graph.explained(src.benchmark_as_questions(spark, sf_dir), _graph_index(spark, sf_dir))
    return rows.select(
        "question_id", F.col("rank").cast("long"), "doc_id", "title", F.round("score", 6).alias("score"), "tokens_read", "source", F.col("path_rank").cast("long"), F.array_join("nodes", " > ").alias("path"),
        F.array_join(F.col("support.edge"), " > ").alias("support"), *[F.array_join(c, "|").alias(c) for c in ("path_docs", "entities", "relations")],
    )


@query(f"""WITH {_GRAPH_SEARCH}, n AS (SELECT question_id, pr, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS step FROM g_v),
  e AS (SELECT question_id, pr, step, regexp_extract(node, '^sent::(.*)::', 1) AS sent_doc, CAST(regexp_extract(node, '::([0-9]+)$', 1) AS INT) AS sent_id FROM n WHERE starts_with(node, 'sent::'))
  SELECT question_id, CAST(pr AS BIGINT) AS path_rank, CAST(step AS INT) AS step, sent_doc, CAST(e.sent_id AS INT) AS sent_id, md5(s) AS sentence FROM e JOIN gs ON gs.doc_id = sent_doc AND gs.sent_id = e.sent_id""")
def graph_evidence(spark, sf_dir):
    """The sentences on all of the best paths."""
    index = _graph_index(spark, sf_dir)
    rows = graph.evidence(graph.paths(src.benchmark_as_questions(spark, sf_dir), index), index)
    return rows.select("question_id", F.col("path_rank").cast("long"), "step", "sent_doc", "sent_id", F.md5("sentence").alias("sentence"))


# ---- routing, judging, agent ----------------------------------------------------------------------------------------


def _template_questions(spark, sf_dir) -> DataFrame:
    """Texts of users, benchmark items and lookups made from titles."""
    users = src.table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("question_id"), F.col("text").alias("question"))
    items = src.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("question_id"), F.col("text").alias("question"))
    parts = src.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    lookups = parts.select(F.concat(F.lit("t"), "p_partkey").alias("question_id"), F.concat(F.lit('Find the document titled "'), "p_name", F.lit('"')).alias("question"))
    numbers = parts.select(F.concat(F.lit("n"), "p_partkey").alias("question_id"), F.concat(F.lit("Which page mentions "), "p_size", F.lit(" and who was born in the city of Old "), F.initcap("p_name"), F.lit("?")).alias("question"))
    return users.union(items).union(lookups).union(numbers)


_ASKED = """asked AS (SELECT 'c' || conv_id || '_' || turn AS question_id, text AS question FROM conversations WHERE role = 'user' UNION ALL SELECT 'b' || item_id, text FROM benchmark
  UNION ALL SELECT 't' || p_partkey, 'Find the document titled "' || p_name || '"' FROM part
  UNION ALL SELECT 'n' || p_partkey, 'Which page mentions ' || p_size || ' and who was born in the city of Old ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(substr(w, 2))), ' ') || '?' FROM part)"""


def _has(words: list[str]) -> str:
    return f"list_has_any(tok, [{', '.join(repr(w) for w in words)}])"


_BRIDGE_SQL = " + ".join(f"CAST(regexp_matches(lower(question), '{p}') AS INT)" for p in routing.BRIDGES)
_TITLE_SQL = r"""regexp_matches(question, '(?i)\bfind the document titled\s+"[^"]+"|\bdocument titled\s+"[^"]+"|\b(?:file|document|article|entry) (?:named|called|titled)\s+"[^"]+"')"""


def _route_sql(asked: str, p: str = "") -> str:
    """Questions with routing signals and tool, ``{p}routed``."""
    return f"""{p}rs AS (SELECT *, regexp_extract_all(lower(question), '[a-z0-9]+') AS tok, len({_ents('question')}) AS ne, len({_nums('question')}) AS nn,
    len(list_filter(list_transform(regexp_extract_all(question, '"([^"]+)"', 1), lambda p: trim(p)), lambda p: p <> '')) AS np, {_TITLE_SQL} AS et, contains(lower(question), 'evidence for this claim') AS cl, {_BRIDGE_SQL} AS br FROM {asked}),
  {p}rf AS (SELECT *, {_has(routing.FILE_CUES)} AS fc, {_has(routing.LOOKUP_CUES)} AS lc, {_has(routing.WEAK_CUES)} AS wc,
    len(list_intersect(list_distinct(tok), [{', '.join(repr(w) for w in routing.GRAPH_CUES)}])) AS gc FROM {p}rs),
  {p}rg AS (SELECT *, round(5.0 * et::INT + 2.2 * (np > 0)::INT + 2.0 * fc::INT + 1.5 * lc::INT + 1.3 * (nn > 0 AND (fc OR lc OR wc))::INT + 0.8 * (wc AND (fc OR lc))::INT, 6)::DOUBLE AS file_score,
    round(CASE WHEN cl THEN 0 ELSE CASE WHEN ne >= 2 THEN 1.6 WHEN ne = 1 THEN 0.6 ELSE 0 END + least(2.4, 0.8 * gc) + least(2.4, 1.2 * br) END, 6)::DOUBLE AS graph_score FROM {p}rf),
  {p}routed AS MATERIALIZED (SELECT *, CASE WHEN cl AND file_score < 4 THEN 'dense' WHEN file_score >= 4 AND file_score >= graph_score THEN 'file_fts' WHEN graph_score >= 3 THEN 'graph_path'
    WHEN file_score >= 3 THEN 'file_fts' ELSE 'dense' END AS tool FROM {p}rg)"""


@query(f"WITH {_ASKED}, {_route_sql('asked')} SELECT question_id, file_score, graph_score, tool FROM routed")
def route_questions(spark, sf_dir):
    return routing.route(_template_questions(spark, sf_dir)).select("question_id", "file_score", "graph_score", "tool")


def _lookup_questions(spark, sf_dir) -> DataFrame:
    return src.benchmark_as_questions(spark, sf_dir).select("question_id", "question")


def _judge_sql(routed: str, first: str, p: str = "") -> str:
    """Verdicts ``{p}judged`` on the first lists ``first(question_id, rank, title, score)`` of routed questions."""
    covered = "contains(t_norm, e) OR (len(list_filter(string_split(e, ' '), lambda w: len(w) > 2)) > 0 AND len(list_filter(string_split(e, ' '), lambda w: len(w) > 2 AND NOT contains(t_norm, w))) = 0)"
    rule = lambda when, tool, confidence, protect: (when, tool, confidence, protect)
    one = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    tables = {
        "dense": ("graph_path", [
            rule("semantic AND NOT file_need AND NOT graph_need", None, "CASE WHEN confident THEN 0.84 ELSE 0.74 END", "1"),
            rule("file_need", "file_fts", "0.76", one("confident")),
            rule("graph_need", "graph_path", "CASE WHEN graph_score >= 3 OR br > 0 THEN 0.84 ELSE 0.74 END", one("confident OR coverage > 0")),
            rule("file_score >= 3.5", "file_fts", "0.68", one("confident")),
            rule("true", None, "CASE WHEN confident THEN 0.72 ELSE 0.62 END", one("confident")),
        ]),
        "file_fts": ("dense", [
            rule("file_score >= 4 AND anchor AND NOT graph_need", None, "0.90", "1"), rule("graph_need", "graph_path", "0.78", one("anchor OR coverage > 0")),
            rule("file_score >= 3.5 AND anchor", None, "0.82", "1"), rule("true", "dense", "0.66", one("anchor")),
        ]),
        "graph_path": ("dense", [
            rule("file_need", "file_fts", "0.78", one("coverage > 0")), rule("graph_score >= 3 AND (coverage >= 0.5 OR ne <= 1 OR overlap >= 2)", None, "0.82", "1"),
            rule("true", "dense", "0.68", one("graph_score >= 2.4")),
        ]),
    }
    every = [(f"tool = '{tool}' AND ({when})", nxt, confidence, protect) for tool, (other, rules) in tables.items() for when, nxt, confidence, protect in [rule("lacking", other, "0.95", "0"), *rules]]
    pick = lambda k: "CASE " + " ".join(f"WHEN {r[0]} THEN {('NULL' if r[k] is None else repr(r[k])) if k == 1 else r[k]}" for r in every) + " END"
    return f"""{p}top AS (SELECT question_id, list(title ORDER BY rank) AS titles, list(score ORDER BY rank) AS scores FROM {first} WHERE rank <= 5 GROUP BY question_id),
  {p}j0 AS (SELECT r.*, titles IS NULL AS lacking, coalesce(titles, []) AS titles, coalesce(scores[1], 0) AS s1, coalesce(scores[1], 0) - coalesce(scores[2], 0) AS gap, array_to_string(coalesce(titles, []), ' ') AS joined,
    {_kws('question', 12)} AS q_words, {_ents('question')} AS e_list, {_nums('question')} AS n_list, list_filter(list_transform(regexp_extract_all(question, '"([^"]+)"', 1), lambda x: {_norm('x')}), lambda x: x <> '') AS anchors FROM {routed} r LEFT JOIN {p}top USING (question_id)),
  {p}j1 AS (SELECT *, {_kws('joined', 35)} AS t_words, {_norm('joined')} AS t_norm, list_slice(titles, 1, 3) AS raw3 FROM {p}j0),
  {p}j2 AS (SELECT *, len(list_intersect(q_words, t_words)) AS overlap, len(list_filter(e_list, lambda e: {covered})) AS covered, list_transform(raw3, lambda x: {_norm('x')}) AS norm3 FROM {p}j1),
  {p}j3 AS (SELECT *, CASE WHEN len(q_words) > 0 THEN overlap / len(q_words) ELSE 0 END AS ratio, CASE WHEN ne > 0 THEN covered / ne ELSE 0 END AS coverage,
    len(list_filter(anchors, lambda a: len(list_filter(norm3, lambda t: contains(t, a) OR contains(a, t))) > 0)) > 0 OR len(list_filter(n_list, lambda a: len(list_filter(raw3, lambda t: contains(t, a))) > 0)) > 0 AS anchor, s1 >= 0.72 AND gap >= 0.14 AS confident FROM {p}j2),
  {p}j4 AS (SELECT *, file_score < 3 AND br = 0 AND graph_score < 3.2 AND s1 >= 0.58 AND (gap >= 0.08 OR overlap >= 2 OR coverage >= 0.5) AND (coverage >= 0.5 OR ratio >= 0.25 OR overlap >= 2) AS semantic,
    graph_score >= 3 OR ((br > 0 OR gc > 0 OR graph_score >= 2.4) AND ((ne >= 2 AND coverage < 0.67) OR NOT confident OR gap < 0.12)) AS graph_need, file_score >= 4 OR (file_score >= 3.5 AND anchor) AS file_need FROM {p}j3),
  {p}judged AS MATERIALIZED (SELECT *, {pick(1)} AS next_tool, ({pick(2)})::DOUBLE AS confidence, least({pick(3)}, len(titles)) AS protect FROM {p}j4)"""


_FIRST_OF_ALL = f"{_FTS}, {_route_sql('questions')}, {_judge_sql('routed', 'rk')}"


@query(f"WITH {_FIRST_OF_ALL} SELECT question_id, tool, next_tool IS NULL AS sufficient, next_tool, confidence, CAST(protect AS INT) AS protect, CAST(overlap AS INT) AS overlap, round(coverage, 6)::DOUBLE AS coverage FROM judged")
def judge_decisions(spark, sf_dir):
    routed = routing.route(_lookup_questions(spark, sf_dir))
    judged = routing.judge(routed, fts.search(routed, _fts_index(spark, sf_dir)))
    return judged.select("question_id", "tool", "sufficient", "next_tool", "confidence", "protect", "overlap", F.round("coverage", 6).alias("coverage"))


_HASHED = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)"


def _vectors_sql(rows: str, key: str, text: str, p: str) -> str:
    """Unit vectors ``{p}v`` by component and the keys ``{p}k`` that have one."""
    kept = f"list_filter({_toks(text)}, lambda t: len(t) > 2 AND NOT list_contains({_STOP}, t))"
    return f"""{p}w AS (SELECT {key} AS k, unnest({kept}) AS w FROM {rows}), {p}c AS (SELECT k, {_HASHED} % {dense.HASHED} AS a, sum(CASE WHEN {_HASHED} & 65536 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {p}w GROUP BY ALL),
  {p}k AS (SELECT k, sqrt(sum(v * v)) AS n FROM {p}c GROUP BY k), {p}v AS MATERIALIZED (SELECT k, a, v / CASE WHEN n = 0 THEN 1 ELSE n END AS v FROM {p}c JOIN {p}k USING (k))"""


def _dense_sql(asked: str, p: str) -> str:
    """Ranked documents ``{p}r``, over the documents' vectors ``dv_v`` and ``dv_k``."""
    return f"""{_vectors_sql(asked, 'question_id', 'question', p)},
  {p}d AS (SELECT q.k AS question_id, d.k AS doc_id, sum(q.v * d.v) AS s FROM {p}v q JOIN dv_v d USING (a) GROUP BY ALL), {p}e AS (SELECT q.k AS question_id, d.k AS doc_id, coalesce(s, 0) AS score FROM {p}k q CROSS JOIN dv_k d LEFT JOIN {p}d x ON x.question_id = q.k AND x.doc_id = d.k),
  {p}r AS (SELECT question_id, doc_id, title, score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {p}e JOIN corpus USING (doc_id))"""


def _tools_sql(asked: str, tool: str, p: str) -> str:
    """Every question of ``asked`` through the retriever that its column ``tool`` names: ``{p}found``, five documents each."""
    of = lambda name: f"(SELECT question_id, question FROM {asked} WHERE {tool} = '{name}')"
    pick = lambda rows: f"SELECT question_id, CAST(doc_id AS VARCHAR) AS doc_id, title, score::DOUBLE AS score, rank FROM {rows} WHERE rank <= 5"
    return f"""{_bm25_sql(of('file_fts'), f'{p}f_')}, {_fts_sql(of('file_fts'), f'{p}f_')}, {graph_sql.search(of('graph_path'), f'{p}g_', _norm, _nums, _ents, _kws, _toks)}, {_dense_sql(of('dense'), f'{p}d_')},
  {p}found AS MATERIALIZED ({pick(f'{p}f_rk')} UNION ALL {pick(f'{p}g_r')} UNION ALL {pick(f'{p}d_r')})"""


def _without_corpus(ctes: str) -> str:
    return ctes.removeprefix(_CORPUS).lstrip(", ")


_ALL_INDEXES = f"""{_FIELDS}, {_SIZES}, {_without_corpus(_GRAPH_INDEX)}, dt AS (SELECT doc_id, trim(title || '. ' || text, ' ') AS body FROM corpus), {_vectors_sql('dt', 'doc_id', 'body', 'dv_')}"""
_ROUTED = f"{_ALL_INDEXES}, {_QUESTIONS}, {_route_sql('questions')}, {_tools_sql('routed', 'tool', 'a_')}"
_AGENT = f"""{_ROUTED}, {_judge_sql('routed', 'a_found')}, again AS (SELECT question_id, next_tool, CASE WHEN next_tool = 'graph_path' THEN array_to_string(list_concat([question], list_slice(titles, 1, 2)), ' ') ELSE question END AS question FROM judged WHERE next_tool IS NOT NULL),
  {_tools_sql('again', 'next_tool', 'b_')},
  weights AS (SELECT question_id, protect, CASE WHEN tool = 'file_fts' AND anchor THEN 1.20 WHEN tool = 'dense' AND confident THEN 1.10 ELSE 1.0 END AS w1, CASE WHEN next_tool = 'graph_path' AND graph_need THEN 1.35 WHEN next_tool = 'file_fts' AND file_need THEN 1.25 ELSE 1.0 END AS w2 FROM judged WHERE next_tool IS NOT NULL),
  two AS (SELECT question_id, doc_id, title, rank, 0 AS turn FROM a_found UNION ALL SELECT question_id, doc_id, title, rank, 1 FROM b_found),
  mg AS (SELECT question_id, doc_id, sum(CASE WHEN turn = 0 THEN w1 ELSE w2 END / (60 + rank))::DOUBLE AS score, arg_min(title, turn) AS title, min(CASE WHEN turn = 0 THEN rank END) AS fr, any_value(protect) AS pr FROM two JOIN weights USING (question_id) GROUP BY ALL),
  mr AS (SELECT question_id, doc_id, title, score, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN fr <= pr THEN 0 ELSE 1 END, CASE WHEN fr <= pr THEN fr ELSE 0 END, round(score, 12) DESC, title, doc_id) AS rank FROM mg),
  fin AS (SELECT question_id, rank, doc_id, title, score FROM mr WHERE rank <= 5 UNION ALL SELECT question_id, rank, doc_id, title, score FROM a_found WHERE question_id NOT IN (SELECT question_id FROM weights))"""


@query(f"""WITH {_AGENT} SELECT question_id, CAST(rank AS BIGINT) AS rank, doc_id, title, round(score, 6) AS score, tool AS first_tool, next_tool AS second_tool, CASE WHEN next_tool IS NULL THEN 1 ELSE 2 END AS tool_calls FROM fin JOIN judged USING (question_id)""")
def agent_predictions(spark, sf_dir):
    words, built = _fts_index(spark, sf_dir), _graph_index(spark, sf_dir)
    as_text = lambda rows: rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    tools = {"file_fts": lambda q: as_text(fts.search(q, words)), "graph_path": lambda q: graph.search(q, built),
             "dense": lambda q: as_text(dense.search(q, _dense_index(spark, sf_dir), words.docs))}
    return agent.run(_lookup_questions(spark, sf_dir), tools).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


# ---- fusion and evaluation over a log of ranked lists ---------------------------------------------------------------


def _ranked_log(spark, sf_dir) -> DataFrame:
    """``events`` read as ranked lists: users ask, event types are methods, values are scores."""
    rows = src.table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    order = W.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id")
    rows = rows.select("*", F.row_number().over(order).alias("rank"))
    doc = F.col("event_id") % 20
    return rows.select(F.col("user_id").alias("question_id"), F.col("event_type").alias("method"), "rank", doc.alias("doc_id"), F.concat(F.lit("t"), doc % 7).alias("title"), F.col("value").alias("score"))


_LOG = """log AS (SELECT user_id AS question_id, event_type AS method, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rank, event_id % 20 AS doc_id,
  't' || (event_id % 20) % 7 AS title, value AS score FROM events)"""


@query(f"""WITH {_LOG}, f AS (SELECT question_id, doc_id, sum(1.0 / (60 + rank))::DOUBLE AS score, min(title) AS title FROM log GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, title, doc_id) AS rank FROM f) SELECT question_id, CAST(rank AS BIGINT) AS rank, doc_id, title, round(score, 6) AS score FROM r WHERE rank <= 5""")
def rrf_fusion(spark, sf_dir):
    return fusion.rrf(_ranked_log(spark, sf_dir)).select("question_id", F.col("rank").cast("long"), "doc_id", "title", F.round("score", 6).alias("score"))


_FIRST_TWO = "one AS (SELECT question_id, doc_id, title, min(rank) AS rank FROM log WHERE method = 'click' GROUP BY ALL), two AS (SELECT question_id, doc_id, title, min(rank) AS rank FROM log WHERE method = 'view' GROUP BY ALL)"


@query(f"""WITH {_LOG}, {_FIRST_TWO}, w AS (SELECT *, 0 AS turn FROM one UNION ALL SELECT *, 1 FROM two), q AS (SELECT question_id, question_id % 4 AS protect FROM one GROUP BY ALL),
  m AS (SELECT question_id, doc_id, sum(CASE WHEN turn = 0 THEN 1.2 ELSE 1.35 END / (60 + rank))::DOUBLE AS score, min(title) AS title, min(CASE WHEN turn = 0 THEN rank END) AS fr, any_value(protect) AS p FROM w JOIN q USING (question_id) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN fr <= p THEN 0 ELSE 1 END, CASE WHEN fr <= p THEN fr ELSE 0 END, round(score, 12) DESC, title, doc_id) AS rank FROM m)
  SELECT question_id, CAST(rank AS BIGINT) AS rank, doc_id, title, round(score, 6) AS score FROM r WHERE rank <= 5""")
def protected_merge(spark, sf_dir):
    rows = _ranked_log(spark, sf_dir)
    best = lambda m: rows.filter(F.col("method") == m).groupBy("question_id", "doc_id", "title").agg(F.min("rank").alias("rank"))
    one, two = best("click"), best("view")
    decisions = one.select("question_id").distinct().select("question_id", F.lit(1.2).alias("first_weight"), F.lit(1.35).alias("second_weight"), (F.col("question_id") % 4).alias("protect"))
    return fusion.protected_merge(one, two, decisions).select("question_id", F.col("rank").cast("long"), "doc_id", "title", F.round("score", 6).alias("score"))


@query(f"""WITH {_LOG}, {_FIRST_TWO}, w AS (SELECT *, 0 AS turn FROM one UNION ALL SELECT *, 1 FROM two), q AS (SELECT question_id, question_id % 4 AS protect FROM one GROUP BY ALL),
  m AS (SELECT question_id, doc_id, sum(CASE WHEN turn = 0 THEN 1.2 ELSE 1.35 END / (60 + rank))::DOUBLE AS score, min(title) AS title, min(CASE WHEN turn = 0 THEN rank END) AS fr, any_value(protect) AS p,
    string_agg(CASE WHEN turn = 0 THEN 'click:' ELSE 'view:' END || rank, '|' ORDER BY turn) AS ranks, string_agg(CASE WHEN turn = 0 THEN 'click:1.2' ELSE 'view:1.35' END, '|' ORDER BY turn) AS weights FROM w JOIN q USING (question_id) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN fr <= p THEN 0 ELSE 1 END, CASE WHEN fr <= p THEN fr ELSE 0 END, round(score, 12) DESC, title, doc_id) AS rank FROM m)
  SELECT question_id, CAST(rank AS BIGINT) AS rank, doc_id, ranks, weights FROM r WHERE rank <= 5""")
def merge_maps(spark, sf_dir):
    """What each list of a merge gave to each document."""
    rows = _ranked_log(spark, sf_dir)
    best = lambda m: rows.filter(F.col("method") == m).groupBy("question_id", "doc_id", "title").agg(F.min("rank").alias("rank")).withColumn("tool", F.lit(m))
    one, two = best("click"), best("view")
    decisions = one.select("question_id").distinct().select("question_id", F.lit(1.2).alias("first_weight"), F.lit(1.35).alias("second_weight"), (F.col("question_id") % 4).alias("protect"))
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "|")
    merged = fusion.protected_merge(one, two, decisions, maps=True)
    return merged.select("question_id", F.col("rank").cast("long"), "doc_id", shown("ranks").alias("ranks"), shown("weights").alias("weights"))


def _log_evaluation(spark, sf_dir) -> DataFrame:
    rows = _ranked_log(spark, sf_dir)
    gold = rows.select("question_id").distinct().select("question_id", F.explode(F.array(F.col("question_id") % 20, (F.col("question_id") * 7) % 20)).alias("doc_id")).distinct()
    questions = rows.select("question_id").distinct().withColumn("task_type", F.concat(F.lit("task"), F.col("question_id") % 3))
    latency = rows.groupBy("question_id", "method").agg(F.max("score").alias("latency_ms"), F.count("*").alias("tokens_read"))
    return metrics.evaluate(rows.filter("rank <= 5").join(latency, ["question_id", "method"]), gold, questions)


_EVAL = f"""{_LOG}, g AS (SELECT DISTINCT question_id, unnest([question_id % 20, (question_id * 7) % 20]) AS doc_id FROM (SELECT DISTINCT question_id FROM log)), gc AS (SELECT question_id, count(*) AS n FROM g GROUP BY ALL),
  lat AS (SELECT question_id, method, max(score) AS latency_ms, count(*) AS tokens_read FROM log GROUP BY ALL), ks AS (SELECT unnest([1, 3, 5]) AS k),
  cut AS (SELECT question_id, method, k, doc_id, min(rank) AS rank FROM log CROSS JOIN ks WHERE rank <= k GROUP BY ALL),
  d AS (SELECT *, row_number() OVER (PARTITION BY question_id, method, k ORDER BY rank) AS pos FROM cut),
  rows AS (SELECT d.question_id, d.method, 'task' || d.question_id % 3 AS task_type, k, any_value(gc.n) AS gold_count, count(*) AS retrieved, count(g.doc_id) AS matched, min(CASE WHEN g.doc_id IS NOT NULL THEN pos END) AS first,
    any_value(latency_ms) AS latency_ms, any_value(tokens_read) AS tokens_read FROM d JOIN gc USING (question_id) JOIN lat USING (question_id, method) LEFT JOIN g ON g.question_id = d.question_id AND g.doc_id = d.doc_id GROUP BY d.question_id, d.method, k),
  ev AS (SELECT *, matched / gold_count AS evidence_recall, CASE WHEN matched = gold_count THEN 1.0 ELSE 0.0 END::DOUBLE AS complete_recall, coalesce(1.0 / first, 0)::DOUBLE AS mrr FROM rows)"""


@query(f"""WITH {_EVAL} SELECT question_id, method, task_type, CAST(k AS BIGINT) AS k, CAST(gold_count AS BIGINT) AS gold_count, CAST(retrieved AS BIGINT) AS retrieved, CAST(matched AS BIGINT) AS matched,
  round(evidence_recall, 6) AS evidence_recall, complete_recall, round(mrr, 6) AS mrr, round(latency_ms, 6) AS latency_ms, tokens_read FROM ev""")
def eval_rows(spark, sf_dir):
    rows = _log_evaluation(spark, sf_dir)
    whole = [F.col(c).cast("long") for c in ("k", "gold_count", "retrieved", "matched")]
    return rows.select("question_id", "method", "task_type", *whole, F.round("evidence_recall", 6).alias("evidence_recall"), "complete_recall", F.round("mrr", 6).alias("mrr"), F.round("latency_ms", 6).alias("latency_ms"), "tokens_read")


@query(f"""WITH {_EVAL} SELECT method, CAST(k AS BIGINT) AS k, coalesce(task_type, 'overall') AS group_name, count(*) AS n, round(avg(evidence_recall), 6) AS evidence_recall, round(avg(complete_recall), 6) AS complete_recall,
  round(avg(mrr), 6) AS mrr, round(avg(latency_ms), 4) AS latency_ms, round(quantile_cont(latency_ms, 0.95), 4) AS latency_p95 FROM ev GROUP BY GROUPING SETS ((method, k), (method, k, task_type))""")
def summary_grouping_sets(spark, sf_dir):
    rows = metrics.summary(_log_evaluation(spark, sf_dir))
    return rows.select("method", F.col("k").cast("long"), "group_name", "n", *[F.round(c, 6).alias(c) for c in ("evidence_recall", "complete_recall", "mrr")], F.round("latency_ms", 4).alias("latency_ms"), F.round("latency_p95", 4).alias("latency_p95"))


@query(f"""WITH {_EVAL}, b AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY complete_recall DESC, matched DESC, evidence_recall DESC, mrr DESC, latency_ms, method) AS n FROM ev WHERE k = 5)
  SELECT question_id, method, CAST(matched AS BIGINT) AS matched, complete_recall FROM b WHERE n = 1""")
def oracle_select(spark, sf_dir):
    rows = _log_evaluation(spark, sf_dir).filter("k = 5")
    order = sorted(r[0] for r in rows.select("method").distinct().collect())  # a handful of methods
    return fusion.oracle_choice(rows, order).select("question_id", "method", F.col("matched").cast("long"), "complete_recall")


@query(f"""WITH {_EVAL} SELECT coalesce(method, 'total') AS method, CAST(count(*) FILTER (task_type = 'task0') AS BIGINT) AS task0, CAST(count(*) FILTER (task_type = 'task1') AS BIGINT) AS task1, CAST(count(*) FILTER (task_type = 'task2') AS BIGINT) AS task2,
  count(*) AS total FROM ev WHERE k = 5 AND complete_recall < 1 GROUP BY ROLLUP (method)""")
def failure_pivot(spark, sf_dir):
    rows = _log_evaluation(spark, sf_dir).filter("k = 5 and complete_recall < 1")
    counts = [F.count_if(F.col("task_type") == t).alias(t) for t in ("task0", "task1", "task2")]
    return rows.rollup("method").agg(*counts, F.count("*").alias("total")).withColumn("method", F.coalesce("method", F.lit("total")))


@query(f"""WITH {_EVAL}, s AS (SELECT method, avg(evidence_recall) AS evidence_recall, avg(latency_ms) AS latency_ms FROM ev WHERE k = 5 GROUP BY method),
  b AS (SELECT min(evidence_recall) AS a, max(evidence_recall) AS z, min(latency_ms) AS la, max(latency_ms) AS lz FROM s)
  SELECT method, round(CASE WHEN z = a THEN 1 ELSE (evidence_recall - a) / (z - a) END, 6) AS evidence_recall, round(CASE WHEN lz = la THEN 1 ELSE 1 - (latency_ms - la) / (lz - la) END, 6) AS latency_ms FROM s CROSS JOIN b""")
def minmax_scaled(spark, sf_dir):
    means = _log_evaluation(spark, sf_dir).filter("k = 5").groupBy("method").agg(F.avg("evidence_recall").alias("evidence_recall"), F.avg("latency_ms").alias("latency_ms"))
    scaled = metrics.minmax_scaled(means, ["evidence_recall", "latency_ms"], ("latency_ms",))
    return scaled.select("method", F.round("evidence_recall", 6).alias("evidence_recall"), F.round("latency_ms", 6).alias("latency_ms"))


@query(f"""WITH {_EVAL}, m AS (SELECT method, task_type, avg(evidence_recall) AS value FROM ev WHERE k = 5 GROUP BY ALL)
  SELECT method, task_type, round(value, 6) AS value, round(max(value) OVER (PARTITION BY task_type) - value, 6) AS gap FROM m""")
def oracle_gap(spark, sf_dir):
    rows = reports.gap_to_best(_log_evaluation(spark, sf_dir).filter("k = 5"), "evidence_recall")
    return rows.select("method", "task_type", F.round("value", 6).alias("value"), F.round("gap", 6).alias("gap"))


@query(f"""WITH {_EVAL} SELECT method, round(avg(mrr) FILTER (task_type = 'task0'), 6) AS task0, round(avg(mrr) FILTER (task_type = 'task1'), 6) AS task1, round(avg(mrr) FILTER (task_type = 'task2'), 6) AS task2 FROM ev WHERE k = 5 GROUP BY method""")
def method_pivot(spark, sf_dir):
    rows = reports.by_task(_log_evaluation(spark, sf_dir).filter("k = 5"), "mrr", ["task0", "task1", "task2"])
    return rows.select("method", *[F.round(t, 6).alias(t) for t in ("task0", "task1", "task2")])


@query(f"""WITH {_EVAL}, f AS (SELECT * FROM ev WHERE k = 5), t AS (SELECT method, task_type, avg(complete_recall) AS c FROM f GROUP BY ALL), w AS (SELECT method, min(c) AS worst FROM t GROUP BY ALL)
  SELECT method, round(1000 * avg(complete_recall) / avg(tokens_read), 6) AS complete_per_kilotoken, round(1 - avg(complete_recall), 6) AS failure_rate, round(avg(evidence_recall) - avg(complete_recall), 6) AS evidence_gap,
  round(any_value(worst), 6) AS worst_task FROM f JOIN w USING (method) GROUP BY method""")
def cost_ratios(spark, sf_dir):
    rows = reports.cost_ratios(_log_evaluation(spark, sf_dir).filter("k = 5"))
    return rows.select("method", *[F.round(c, 6).alias(c) for c in ("complete_per_kilotoken", "failure_rate", "evidence_gap", "worst_task")])


@query(f"""WITH {_FTS}, g AS (SELECT question_id, d.doc_id, c.title FROM questions q JOIN documents d ON contains(d.text, q.question) JOIN corpus c ON c.doc_id = d.doc_id), top AS (SELECT * FROM rk WHERE rank <= 1),
  r AS (SELECT question_id, string_agg(title, ' | ' ORDER BY rank) AS retrieved_titles FROM top GROUP BY question_id),
  m AS (SELECT g.question_id, count(*) AS gold_count, string_agg(g.title, ' | ' ORDER BY g.doc_id) AS gold_titles, string_agg(g.title, ' | ' ORDER BY g.doc_id) FILTER (top.doc_id IS NULL) AS missed_titles
    FROM g LEFT JOIN top ON top.question_id = g.question_id AND top.doc_id = g.doc_id GROUP BY g.question_id)
  SELECT question_id, 'file_fts' AS method, CAST(gold_count AS INT) AS gold_count, gold_titles, missed_titles, retrieved_titles FROM m JOIN r USING (question_id) WHERE missed_titles IS NOT NULL""")
def failure_cases(spark, sf_dir):
    questions, corpus = src.benchmark_as_questions(spark, sf_dir), src.documents_as_corpus(spark, sf_dir)
    found = fts.search(questions, _fts_index(spark, sf_dir)).select("question_id", "rank", "doc_id").withColumn("method", F.lit("file_fts"))
    return reports.failure_cases(found, src.gold_by_containment(questions, corpus), corpus.select("doc_id", "title"), top_k=1)


@query(f"""WITH {_LOG}, c AS (SELECT question_id, count(DISTINCT method) AS n FROM log GROUP BY ALL) SELECT question_id FROM c WHERE n = (SELECT count(DISTINCT method) FROM log)""")
def shared_questions(spark, sf_dir):
    rows = _ranked_log(spark, sf_dir)
    return fusion.shared_questions(rows, rows.select("method").distinct().count())


@query(f"""WITH {_CORPUS}, s AS (SELECT doc_id, unnest(sentences) AS sentence, generate_subscripts(sentences, 1) - 1 AS sent_id FROM corpus)
  SELECT doc_id, CAST(sent_id AS BIGINT) AS sent_id FROM s WHERE length(trim(sentence)) BETWEEN 60 AND 260 AND NOT regexp_matches(sentence, '[\\[\\]{{}}]') AND len(list_filter(regexp_split_to_array(trim(sentence), '\\s+'), lambda w: w <> '')) >= 8""")
def clean_sentences(spark, sf_dir):
    rows = src.documents_as_corpus(spark, sf_dir).select("doc_id", F.posexplode("sentences").alias("sent_id", "sentence"))
    return rows.filter(samples.is_clean_sentence(F.col("sentence"))).select("doc_id", F.col("sent_id").cast("long"))


@query("SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn = c.turn + 1)")
def resume_unanswered(spark, sf_dir):
    turns = src.table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    key = F.concat_ws("_", "conv_id", F.col("turn"))
    asked = turns.filter("role = 'user'").select(key.alias("question_id"), "conv_id", "turn")
    answered = turns.select(F.concat_ws("_", "conv_id", (F.col("turn") - 1).cast("string")).alias("question_id")).distinct()
    return samples.unanswered(asked, answered).select("conv_id", "turn")


@query("SELECT event_type AS method, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type")
def latency_p95(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events", "event_type", "value")
    return rows.groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(metrics.percentile("value", 0.95), 4).alias("p95"))


_TIMES = " + ".join(f"CASE WHEN d >= '{p}' THEN 1 ELSE 0 END" for p in metrics.POISSON_DIGITS)


def _bootstrap_sql(rows: str, group: str, value: str, p: str = "") -> str:
    """``{p}ci(g, low, high)`` of a value over ``rows`` by ``group``."""
    return f"""{p}dr AS (SELECT {group} AS g, {value} AS v, b, md5('42:' || b || ':' || question_id) AS h FROM {rows} CROSS JOIN (SELECT unnest(generate_series(0, 124)) AS b)),
  {p}ds AS (SELECT g, v, b * 8 + j AS s, substr(h, 4 * j + 1, 4) AS d FROM {p}dr CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS j)),
  {p}dm AS (SELECT g, s, sum(({_TIMES}) * v) / sum({_TIMES}) AS m FROM {p}ds GROUP BY ALL HAVING sum({_TIMES}) > 0), {p}dl AS (SELECT g, list_sort(list(m)) AS ms FROM {p}dm GROUP BY ALL),
  {p}ci AS (SELECT g, ms[26] AS low, ms[975] AS high FROM {p}dl)"""


_SHARES = " + ".join(f"CASE WHEN u >= {p} THEN 1 ELSE 0 END" for p in metrics._POISSON)


@query(f"""WITH {_EVAL}, dr AS (SELECT method, complete_recall AS v, CAST('0x' || substr(md5('42:' || s || ':' || question_id), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u, s FROM ev CROSS JOIN (SELECT unnest(generate_series(1, 1000)) AS s) WHERE k = 5),
  m AS (SELECT method, s, sum(({_SHARES}) * v) / sum({_SHARES}) AS m FROM dr GROUP BY ALL HAVING sum({_SHARES}) > 0), l AS (SELECT method, list_sort(list(m)) AS ms FROM m GROUP BY ALL)
  SELECT method, round(ms[26], 6) AS low, round(ms[975], 6) AS high FROM l""")
def bootstrap_ci(spark, sf_dir):
    rows = _log_evaluation(spark, sf_dir).filter("k = 5")
    found = metrics.bootstrap_ci(rows, "method", "complete_recall", "question_id")
    return found.select("method", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


# ---- dataset construction -------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS pick FROM documents) SELECT doc_id, lang, CAST(pick AS BIGINT) AS pick FROM r WHERE pick <= 60""")
def stratified_sample(spark, sf_dir):
    rows = src.table(spark, sf_dir, "documents", "doc_id", "lang")
    return dataset.stratified_sample(rows, "lang", "doc_id", 60).select("doc_id", "lang", F.col("pick").cast("long"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT doc_id, source FROM r ORDER BY turn, source LIMIT 200""")
def round_robin_limit(spark, sf_dir):
    return dataset.round_robin(src.table(spark, sf_dir, "documents", "doc_id", "source"), "source", "doc_id", 200).select("doc_id", "source")


@query(f"""WITH {_QUESTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY md5('42:' || question_id), question_id) AS p, count(*) OVER (PARTITION BY task_type) AS n FROM questions)
  SELECT question_id, task_type, CASE WHEN p <= greatest(1, least(n - 1, round_even(n * 0.3, 0))) THEN 'dev' ELSE 'test' END AS split FROM r""")
def dev_test_split(spark, sf_dir):
    return dataset.split_dev_test(src.benchmark_as_questions(spark, sf_dir), "task_type", "question_id", 0.3).select("question_id", "task_type", "split")


@query(f"""WITH {_GOLD}, r AS (SELECT doc_id, list_sort(list(DISTINCT question_id)) AS q FROM gold GROUP BY doc_id)
  SELECT doc_id, CASE WHEN q IS NULL THEN 'noise' ELSE 'selected_gold' END AS role, coalesce(array_to_string(q, '|'), '') AS question_ids FROM documents LEFT JOIN r USING (doc_id)""")
def corpus_roles(spark, sf_dir):
    questions, corpus = src.benchmark_as_questions(spark, sf_dir), src.documents_as_corpus(spark, sf_dir)
    rows = dataset.corpus_roles(corpus, src.gold_by_containment(questions, corpus))
    return rows.select("doc_id", "role", F.array_join(F.col("question_ids").cast("array<string>"), "|").alias("question_ids"))


@query(f"""WITH {_CORPUS}, {_GOLD} SELECT count(*) AS documents, count(*) - count(DISTINCT doc_id) AS repeated_documents, count(*) FILTER (trim(title) = '') AS empty_titles, count(*) FILTER (len(sentences) = 0) AS without_sentences,
  (SELECT count(*) FROM questions) AS questions, (SELECT count(*) - count(DISTINCT question_id) FROM questions) AS repeated_questions, (SELECT count(*) FROM gold WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS gold_outside_corpus,
  (SELECT count(*) FROM questions WHERE question_id NOT IN (SELECT question_id FROM gold)) AS questions_without_gold FROM corpus""")
def validate_dataset(spark, sf_dir):
    questions, corpus = src.benchmark_as_questions(spark, sf_dir), src.documents_as_corpus(spark, sf_dir)
    return dataset.validation(corpus, questions, src.gold_by_containment(questions, corpus))


_FORBIDDEN = " OR ".join(f"regexp_matches(lower(question), '\\b{w}\\b')" for w in questions.HOP_FORBIDDEN)


def _basic_sql(q: str, lookup: bool = False) -> str:
    """Sorted issue codes of a question, as a list."""
    language = "" if lookup else f"CASE WHEN {_FORBIDDEN.replace('question', q)} THEN 'contains_file_or_evidence_language' END, "
    return f"""CASE WHEN trim({q}) = '' THEN ['empty_question'] ELSE list_filter([{language}
  CASE WHEN contains(trim({q}), chr(10)) OR contains(trim({q}), chr(13)) THEN 'contains_newline' END, CASE WHEN regexp_matches(lower(trim({q})), '^(rewrite|write|generate) ') THEN 'instruction_like_question' END,
  CASE WHEN NOT ends_with(trim({q}), '?') THEN 'missing_question_mark' END, CASE WHEN length(trim({q})) > 240 THEN 'question_too_long' END,
  CASE WHEN length(trim({q})) < 25 THEN 'question_too_short' END], lambda c: c IS NOT NULL) END"""


@query(f"WITH {_ASKED} SELECT question_id, array_to_string({_basic_sql('question')}, '|') AS issues FROM asked")
def question_issues(spark, sf_dir):
    return _template_questions(spark, sf_dir).select("question_id", _joined(questions.basic(F.col("question"))).alias("issues"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_valid(props)")
def json_payload(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events", "event_id", "props")
    return rows.withColumn("v", tx.parse_json_object(F.col("props"))).filter("v is not null").select("event_id", F.try_variant_get("v", "$.k", "string").alias("k"))


# ---- streaming ------------------------------------------------------------------------------------------------------


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def streaming_latency_windows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = scoring.read_stream(spark, sf_dir, schema, "events.parquet")
    name = f"latency_{abs(hash(sf_dir)) % 10**8}"
    rows = scoring.run_available(_daily(stream), name, f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


def _daily(stream: DataFrame) -> DataFrame:
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days")
    return rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
