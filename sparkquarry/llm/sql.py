"""SQL twins (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

from sparkquarry.llm import substring, templates, tiles

_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + {substring.WINDOW - 1}), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {substring.WINDOW - 1})) AS p FROM d WHERE len(w) >= {substring.WINDOW})),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + {substring.WINDOW - 1})) AS k FROM win JOIN first USING (h) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY k) AS text FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

_EDGE = "'" + templates._EDGE.replace("'", "''") + "'"
_UNITS = "[" + ", ".join(f"'{u}'" for u in templates.UNITS) + "]"
_NUMBER = "regexp_full_match({0}, '[$+-]?[0-9]+([.,:/][0-9]+)*(%|st|nd|rd|th)?')"


def _tokens(w: str) -> str:
    core, before = f"trim(x, {_EDGE})", f"{w}[i - 1]"
    named = f"i > 1 AND {core} <> lower({core}) AND ascii(lower({core})) <> ascii({core}) AND {core} <> upper({core}) AND right({before}, 1) NOT IN ('.', '!', '?', ':')"
    return f"""list_transform({w}, lambda x, i: CASE WHEN {_NUMBER.format(core)} THEN '{templates.NUM}'
      WHEN i > 1 AND list_contains({_UNITS}, lower({core})) AND {_NUMBER.format(f"trim({before}, {_EDGE})")} THEN '{templates.UNIT}' WHEN {named} THEN '{templates.NAME}' ELSE lower({core}) END)"""


_HELD = f"['{templates.NUM}', '{templates.UNIT}', '{templates.NAME}']"
_PAIRS = "list_distinct(list_transform(s, lambda x: {0}))"
_BARE = f"list_transform(w, lambda x: trim(x, {_EDGE}))"


def _merged(source: str, columns: str, words: str = "w") -> str:
    """Runs of names as one token: tokens ``t`` and their words ``v`` from typed words ``u``."""
    starts = f"list_filter(generate_series(1, len(u)), lambda i: NOT (u[i] = '{templates.NAME}' AND i > 1 AND u[i - 1] = '{templates.NAME}'))"
    return f"""SELECT {columns}, list_transform(places, lambda i: u[i]) AS t, list_transform(places, lambda i, j: array_to_string(list_transform(list_slice({words}, i, coalesce(places[j + 1], len(u) + 1) - 1), lambda x: trim(x, {_EDGE})), ' ')) AS v
      FROM (SELECT *, {starts} AS places FROM ({source}))"""


OP4 = f"""
WITH bi AS (SELECT item_id, w FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) >= {templates.LEAST}),
ri AS ({_merged(f"SELECT item_id, w, 0 AS reading, {_tokens('w')} AS u FROM bi", "item_id, w, reading")}
  UNION ALL {_merged(f"SELECT item_id, w, 1 AS reading, list_slice({_tokens('xw')}, 2, len(xw)) AS u FROM (SELECT item_id, w, list_prepend('x', w) AS xw FROM bi)", "item_id, w, reading")}),
led AS (SELECT * REPLACE (CASE WHEN runs THEN list_prepend(substr(v[1], len(trim(w[1], {_EDGE})) + 2), list_slice(v, 2, len(v))) ELSE v END AS v), CASE WHEN runs THEN trim(w[1], {_EDGE}) END AS lead
  FROM (SELECT *, reading = 1 AND v[1] <> trim(w[1], {_EDGE}) AS runs FROM ri)),
spans AS (SELECT *, least(len(t), {templates.SPAN}) AS n FROM led),
typed AS (SELECT * FROM spans WHERE len(t) >= {templates.LEAST}),
items AS (SELECT item_id, w, reading, lead, t, v, n FROM typed UNION ALL SELECT item_id, w, 2, NULL, list_transform({_BARE}, lambda x: lower(x)), {_BARE}, least(len(w), {templates.SPAN}) FROM (SELECT DISTINCT item_id, w FROM bi)),
bd AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
dd AS ({_merged(f"SELECT doc_id, w, {_tokens('w')} AS u FROM bd", "doc_id, false AS plain")} UNION ALL SELECT doc_id, true, list_transform({_BARE}, lambda x: lower(x)), {_BARE} FROM bd),
wi AS (SELECT item_id, reading, reading = 2 AS plain, n, p, array_to_string(list_slice(t, p, p + n - 1), ' ') AS win, len(list_filter(list_slice(t, p, p + n - 1), lambda x: NOT list_contains({_HELD}, x))) AS lit
       FROM (SELECT item_id, reading, n, t, unnest(generate_series(1, len(t) - n + 1)) AS p FROM items)),
sizes AS (SELECT DISTINCT n, plain FROM wi),
wd AS (SELECT doc_id, plain, n, p, array_to_string(list_slice(t, p, p + n - 1), ' ') AS win FROM (SELECT doc_id, plain, n, t, unnest(generate_series(1, len(t) - n + 1)) AS p FROM dd JOIN sizes USING (plain) WHERE len(t) >= n)),
hits AS (SELECT wd.doc_id, wi.item_id, wi.reading, wd.p - wi.p AS shift, wi.p AS p, wi.n FROM wd JOIN wi ON wd.win = wi.win AND wd.n = wi.n AND wd.plain = wi.plain WHERE wi.plain OR lit * 2 >= wi.n),
cov AS (SELECT doc_id, item_id, reading, shift, count(DISTINCT k) AS covered, min(k) AS first, max(k) AS last FROM (SELECT *, unnest(generate_series(p, p + n - 1)) AS k FROM hits) GROUP BY ALL),
lines AS (SELECT c.*, len(i.w) AS item_words, CASE WHEN c.reading = 2 THEN [] ELSE list_filter(list_transform(generate_series(first, last), lambda j: {{'kind': i.t[j], 'other': d.t[j + shift], 'a': i.v[j], 'b': CASE WHEN j = 1 AND i.lead IS NOT NULL THEN substr(d.v[j + shift], len(i.lead) + 2) ELSE d.v[j + shift] END}}),
          lambda x: x.kind = x.other AND list_contains({_HELD}, x.kind)) END AS s
          FROM cov c JOIN items i USING (item_id, reading) JOIN dd d ON d.doc_id = c.doc_id AND d.plain = (c.reading = 2) WHERE covered >= least({templates.COVER}, len(i.t)) AND (i.lead IS NULL OR first > 1 OR starts_with(d.v[first + shift], i.lead || ' '))),
steady AS (SELECT * FROM lines WHERE len({_PAIRS.format("{'k': x.kind, 'a': x.a, 'b': x.b}")}) = len({_PAIRS.format("{'k': x.kind, 'a': x.a}")})
           AND len({_PAIRS.format("{'k': x.kind, 'a': x.a, 'b': x.b}")}) = len({_PAIRS.format("{'k': x.kind, 'b': x.b}")})),
best AS (SELECT *, len(s) AS n_slots, len(list_filter(s, lambda x: x.a <> x.b)) = 0 AS exact FROM steady)
SELECT doc_id, item_id, CAST(item_words AS INT) AS item_words, CAST(covered AS INT) AS covered, CAST(n_slots AS INT) AS n_slots, exact
FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY covered DESC, exact DESC, n_slots DESC) = 1"""

OP13 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
near AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {tiles.THRESHOLD}),
reach AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT reach.u, near.w FROM reach JOIN near ON reach.w = near.u),
least AS (SELECT u, min(w) AS c FROM reach GROUP BY u),
degree AS (SELECT u, count(*) AS n FROM near GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.u LEFT JOIN degree ON vec_id = degree.u"""
