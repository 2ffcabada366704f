"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Words become typed tokens: numbers, units after a number, and names (capitalised words
inside a sentence, of which a run is one name) turn into placeholders, all else into lower case
without surrounding punctuation.  Windows of tokens of every document are joined by hash with those
of the benchmark.  Matches are gathered into alignments of a document and an item, and an
alignment counts if enough of the item is covered and its slots are consistent:
a value of the item always stands against the same value of the document and the other
way round.  So a question with other numbers or names is caught, a chance frame is not.

An item is read in three ways: as it stands; with its first word inside a sentence, where a
capital makes it a name, as a copy behind a comma, a mark or a heading has it (where it runs into another name, as
"If Tom" does, it has to be the same word in the document and is no part of the slot); and word by word, without
placeholders.  The last finds every copy, whatever stands around it: a name beside an item's first or last one would otherwise
be one with it, and windows of which fewer than half the words are literal count only where the words are the same.

Items that read alike but for the values of their slots are one template, joined once; its items part where
the slots are compared.  The benchmark's windows are broadcast if there are few (``common.sized``); beyond that
both sides are shuffled.

Defined results: null and empty texts match nothing; items of fewer than ``LEAST``
words are never matched (they would be found everywhere); items shorter than a window
are one window of their own length; rows that share a doc_id or an item_id count as
texts of their own of which the best match is reported; null ids are ids; an empty
table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import SPACE, let, sized, staged

#: Tokens in a window, covered words that make a leak (or the whole item), shortest item.
SPAN, COVER, LEAST = 8, 13, 5

NUM, UNIT, NAME = "<num>", "<unit>", "<name>"

# Units of measure, in the singular and plural as written.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms ounce ounces pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years cent cents dollar dollars euro euros percent % degree degrees km/h mph kmh watt watts volt volts"
).split()

_EDGE = ".,;:!?\"'()[]{}«»“”‘’…|*_`~<>"


def raw_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def canonical(raw: Column) -> Column:
    """Typed tokens of an array of words, one for each word."""
    edge = F.lit(_EDGE)
    bare = lambda w: F.btrim(w, edge)

    def is_number(core: Column) -> Column:
        first = F.ascii(core)
        return (first.between(48, 57) | first.isin(36, 43, 45)) & core.rlike(r"^[$+-]?[0-9]+([.,:/][0-9]+)*(%|st|nd|rd|th)?$")

    def token(own: Column, w: Column, i: Column) -> Column:
        def by_core(core: Column) -> Column:
            before = F.get(own, i - 1)
            low = F.lower(core)
            named = (core != low) & (F.ascii(low) != F.ascii(core)) & (core != F.upper(core)) & (i > 0) & ~F.right(before, F.lit(1)).isin(".", "!", "?", ":")
            return (
                F.when(is_number(core), F.lit(NUM))
                .when(low.isin(*UNITS) & (i > 0) & is_number(bare(before)), F.lit(UNIT))
                .when(named, F.lit(NAME))
                .otherwise(low)
            )

        return let(bare(w), by_core)

    return let(raw, lambda own: F.transform(own, lambda w, i: token(own, w, i)))


def merged(tokens: Column) -> Column:
    """Where the tokens begin when each run of names is one."""
    after_name = lambda i: (F.get(tokens, i) == NAME) & (i > 0) & (F.get(tokens, i - 1) == NAME)
    every = F.sequence(F.lit(0), F.size(tokens) - 1)
    return F.when(F.size(tokens) > 0, F.filter(every, lambda i: ~after_name(i))).otherwise(F.array().cast("array<int>"))


def plain(raw: Column) -> Column:
    """The words in lower case without surrounding punctuation."""
    return F.transform(raw, lambda w: F.lower(F.btrim(w, F.lit(_EDGE))))


def _inside(raw: Column) -> Column:
    """Typed tokens as of words that follow others in a sentence."""
    return let(canonical(F.concat(F.array(F.lit("x")), raw)), lambda t: F.slice(t, F.lit(2), F.size(t) - 1))


def _spelled(raw: Column, tokens: Column) -> Column:
    """``(t, v)`` of every merged token: the token and its words."""
    words = lambda a, b: F.array_join(F.transform(F.slice(raw, a + 1, b - a), lambda w: F.btrim(w, F.lit(_EDGE))), " ")
    end = lambda starts, j: F.coalesce(F.get(starts, j + 1), F.size(tokens))
    return let(merged(tokens), lambda starts: F.transform(starts, lambda i, j: F.struct(F.get(tokens, i).alias("t"), words(i, end(starts, j)).alias("v"))))


#: Hashes of the placeholders.
_HELD = (NUM, UNIT, NAME)


def _merged(h: Column) -> Column:
    """Token hashes with each run of names as one."""
    name = F.xxhash64(F.lit(NAME))
    return F.filter(h, lambda x, i: (x != name) | (i == 0) | (F.get(h, i - 1) != name))


def _windows_of(docs: DataFrame, sizes: list[int], as_words: bool) -> DataFrame:
    """``(doc, pos, window)``: every window of every document, of each of ``sizes`` tokens; with ``as_words`` of its plain words as well.

    The hashes of a document's tokens are exploded, and a window is hashed from its place in them, in generated code.
    """
    raw = docs.select(F.xxhash64("doc_id", "text").alias("doc"), raw_words(F.col("text")).alias("raw"))
    held = [F.xxhash64(F.lit(x)) for x in _HELD]
    bare = lambda i: F.xxhash64(F.lower(F.btrim(F.get("raw", i), F.lit(_EDGE))))
    plain_of = lambda t: F.transform(t, lambda h, i: F.when(h.isin(*held), bare(i)).otherwise(h))
    ways = lambda t: F.array(F.struct(F.lit(False).alias("words"), _merged(t).alias("h")), *([F.struct(F.lit(True).alias("words"), plain_of(t).alias("h"))] if as_words else []))
    rows = raw.select("doc", F.explode(let(F.transform(canonical(F.col("raw")), lambda t: F.xxhash64(t)), ways)).alias("x")).select("doc", "x.words", "x.h")
    # One explode for all sizes: the rows of a second one would each hold the whole array while they wait.
    k = len(sizes)
    rows = rows.filter(F.size("h") > 0).select("doc", "words", "h", F.explode(F.sequence(F.lit(0), F.size("h") * k - 1)).alias("i"))
    rows = rows.withColumn("pos", F.expr(f"cast(i div {k} as int)"))
    at = lambda n: [F.get("h", F.col("pos") + k) for k in range(n)]
    # Never null, so that no filter on it has to hash it once more.
    one = lambda n: F.when(F.col("words"), F.xxhash64(F.lit(_PLAIN), *at(n))).otherwise(F.xxhash64(*at(n)))
    window, size = one(sizes[0]), F.lit(sizes[0])
    for j, n in enumerate(sizes[1:], 1):
        window, size = F.when(F.col("i") % k == j, one(n)).otherwise(window), F.when(F.col("i") % k == j, n).otherwise(size)
    return rows.filter(F.col("pos") + size <= F.size("h")).select("doc", "pos", window.alias("window"))


def windows(hashes: Column, span: int, salt: str | None = None) -> Column:
    """Hash of every run of ``span`` hashes."""
    seed = [] if salt is None else [F.lit(salt)]

    def roll(h: Column) -> Column:
        at = lambda i: F.xxhash64(*seed, *[F.get(h, i + k) for k in range(span)])
        return F.when(F.size(h) >= span, F.transform(F.sequence(F.lit(0), F.size(h) - span), at)).otherwise(F.array().cast("array<long>"))

    return let(hashes, roll)


def _literal(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: ~t.isin(NUM, UNIT, NAME)))


_PLAIN = "plain"


def _readings(items: DataFrame, span: int) -> DataFrame:
    """``(item, item_id, item_words, reading, lead, own array<t, v>, n)``: the ways to read each item, windows being ``n`` tokens.

    ``lead`` is the word that the first name of an item inside a sentence has to begin with, if any.
    """
    split = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    split = split.select(F.xxhash64("item_id", "text").alias("item"), "item_id", raw_words(F.col("text")).alias("raw"))
    split = split.filter(F.size("raw") >= LEAST).withColumn("item_words", F.size("raw"))
    typed = split.select("*", F.lit("typed").alias("reading"), canonical(F.col("raw")).alias("u"))
    inside = split.select("*", F.lit("inside").alias("reading"), _inside(F.col("raw")).alias("u"))
    # Written at every step: each is used many times by the next, and would be put into it as often.
    both = staged(typed.union(inside), "template-readings")
    both = staged(both.withColumn("own", _spelled(F.col("raw"), F.col("u"))), "template-spelled")
    runs_on = (F.col("reading") == "inside") & (F.get("u", F.lit(0)) == NAME) & (F.get("u", F.lit(1)) == NAME)
    both = both.withColumn("lead", F.when(runs_on, F.btrim(F.get("raw", F.lit(0)), F.lit(_EDGE))))
    shorter = F.transform("own", lambda x, i: F.struct(x["t"].alias("t"), F.when((i == 0) & F.col("lead").isNotNull(), F.substr(x["v"], F.length("lead") + 2)).otherwise(x["v"]).alias("v")))
    both = both.withColumn("own", shorter).withColumn("n", F.least(F.size("own"), F.lit(span)))
    both = staged(both, "template-led")
    as_words = both.dropDuplicates(["item"]).withColumn("own", F.transform("raw", lambda w: F.struct(F.lower(F.btrim(w, F.lit(_EDGE))).alias("t"), F.btrim(w, F.lit(_EDGE)).alias("v"))))
    as_words = as_words.withColumn("reading", F.lit(_PLAIN)).withColumn("n", F.least(F.size("own"), F.lit(span)))
    both = both.filter(F.size("own") >= LEAST)  # fewer tokens are found everywhere
    return both.union(as_words.select(both.columns)).select("item", "item_id", "item_words", "reading", "lead", "own", "n")


def leaks(docs: DataFrame, items: DataFrame, span: int = SPAN, cover: int = COVER) -> DataFrame:
    """``(doc_id, item_id, item_words, covered, n_slots, exact)`` of every leaked item of every document.

    ``covered`` are the item's tokens under matching windows of the best alignment, ``exact`` says that
    no slot was given another value.
    """
    own = _readings(items, span).withColumn("template", F.xxhash64(F.col("own.t"), F.when(F.col("reading") == _PLAIN, _PLAIN).otherwise("typed")))
    own = staged(own.dropDuplicates(["item", "template"]), "template-items")
    patterns = own.groupBy("template").agg(F.any_value(F.col("own.t")).alias("t"), F.any_value("n").alias("n"), F.any_value(F.col("reading") == _PLAIN).alias("words"))
    patterns = staged(patterns, "template-patterns")
    sizes = [(r.n, r.words) for r in patterns.select("n", "words").distinct().orderBy("n", "words").collect()]  # twice span numbers at most
    parts = []
    for n, words in sizes:
        hashed = F.transform("t", lambda t: F.xxhash64(t))
        part = patterns.filter((F.col("n") == n) & (F.col("words") == words)).select("template", "t", "n", F.posexplode(windows(hashed, n, _PLAIN if words else None)).alias("item_pos", "window"))
        parts.append(part.filter(F.lit(words) | (_literal(F.slice("t", F.col("item_pos") + 1, n)) * 2 >= n)).select("window", "template", "item_pos", "n"))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if not parts:
        parts = [patterns.select(F.lit(0).cast("long").alias("window"), "template", F.lit(0).alias("item_pos"), "n")]
    known = parts[0]
    for part in parts[1:]:
        known = known.union(part)
    known = sized(staged(known, "template-windows"))
    found = _windows_of(docs, sorted({n for n, _ in sizes}) or [span], any(w for _, w in sizes)).join(known, "window")
    hits = found.select("doc", "template", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "n")
    lines = hits.groupBy("doc", "template", "shift").agg(F.collect_set("item_pos").alias("at"), F.min("item_pos").alias("first"), F.max(F.col("item_pos") + F.col("n")).alias("stop"), F.max("n").alias("n"))
    lines = lines.withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("n") - 1))))))
    lines = lines.join(sized(patterns.select("template", "words", F.size("t").alias("size"))), "template")
    lines = staged(lines.filter(F.col("covered") >= F.least(F.lit(cover), F.col("size"))).select("doc", "template", "words", "shift", "first", "stop", "covered"), "template-lines")
    by_doc = lines.groupBy("doc").agg(F.collect_list(F.struct("template", "words", "shift", "first", "stop", "covered")).alias("lines"))
    by_doc = sized(staged(by_doc, "template-docs"), "size(lines)")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text").join(by_doc, "doc").distinct()
    texts = texts.select("doc_id", "lines", raw_words(F.col("text")).alias("raw"))
    texts = texts.select("doc_id", "lines", let(canonical(F.col("raw")), lambda t: _spelled(F.col("raw"), t)).alias("typed"))
    cut = texts.select("doc_id", "typed", F.explode("lines").alias("x")).select(
        "doc_id", "x.*", F.when(~F.col("x.words"), F.slice("typed", F.col("x.first") + F.col("x.shift") + 1, F.col("x.stop") - F.col("x.first"))).alias("ours")
    )
    cut = cut.join(sized(own.select("template", "item_id", "item_words", "lead", "own"), "1 + size(own)"), "template")
    led = F.col("lead").isNotNull() & (F.col("first") == 0) & ~F.col("words")
    begins = F.concat(F.col("lead"), F.lit(" "))
    cut = cut.filter(~led | F.startswith(F.get("ours", F.lit(0))["v"], begins))
    rest = F.transform("ours", lambda x, i: F.struct(x["t"].alias("t"), F.when(led & (i == 0), F.substr(x["v"], F.length("lead") + 2)).otherwise(x["v"]).alias("v")))
    cut = cut.withColumn("ours", rest)
    # The slots of what is typed; word by word there are none.
    theirs = F.slice("own", F.col("first") + 1, F.col("stop") - F.col("first"))
    pairs = F.zip_with("ours", theirs, lambda d, i: F.struct(d["t"].alias("kind"), i["t"].alias("item_kind"), i["v"].alias("a"), d["v"].alias("b")))
    slots = staged(cut.withColumn("slots", F.coalesce(F.filter(pairs, lambda p: (p["kind"] == p["item_kind"]) & p["kind"].isin(NUM, UNIT, NAME)), F.array())).drop("ours", "own"), "template-slots")
    distinct = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda p: F.struct(p["kind"].alias("kind"), *[p[n].alias(n) for n in names]))))
    steady = (distinct("a", "b") == distinct("a")) & (distinct("a", "b") == distinct("b"))
    kept = slots.filter(F.col("words") | steady).select(
        "doc_id", "item_id", "item_words", "covered", F.size("slots").alias("n_slots"), (F.size(F.filter("slots", lambda p: p["a"] != p["b"])) == 0).alias("exact")
    )
    best = F.max(F.struct("covered", "exact", "n_slots", "item_words")).alias("best")
    return kept.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.item_words", "best.covered", "best.n_slots", "best.exact")
