"""Document fingerprints by winnowing, in DataFrame expressions only.

Words (lower case, between white space) are hashed; a gram of ``gram`` words gets a
rolling polynomial of its words' hashes; of every ``window`` neighbouring grams the one
with the least hash is kept, the rightmost of equal ones, with its position.  Any run of
``gram + window - 1`` equal words in two texts is sure to give them a fingerprint in common.

Likeness of two fingerprints is the Dice share of their distinct hashes; two empty ones
are alike (1), an empty and a full one are not (0).

Defined results: a null text counts as empty and has the empty fingerprint; fewer words
than a gram form one gram, fewer grams than a window form one window; equal texts have
equal fingerprints; texts are taken whole; extra columns are ignored; an empty table
gives no rows.  Rows that share a doc_id follow each other by a hash of their text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkquarry.llm.common import SPACE, let

GRAM, WINDOW = 3, 8

_BASE = 1_000_003


def gram_hashes(text: Column, gram: int = GRAM) -> Column:
    """Hash of each run of ``gram`` words; of fewer words, one over all of them."""
    parts = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 40) - 1)))

    def roll(h: Column) -> Column:
        whole = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * _BASE + x) % F.lit((1 << 43) - 57))

        def at(i: Column) -> Column:
            value = F.get(h, i)
            for k in range(1, gram):
                value = (value * _BASE + F.get(h, i + k)) % F.lit((1 << 43) - 57)
            # Scrambled, so that the least one is not that of the least last word.
            return F.xxhash64(value)

        return (
            F.when(F.size(h) >= gram, F.transform(F.sequence(F.lit(0), F.size(h) - gram), at))
            .when(F.size(h) > 0, F.array(F.xxhash64(whole)))
            .otherwise(F.array().cast("array<long>"))
        )

    return let(hashed, roll)


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """``array<struct<pos int, hash long>>``: the selected grams in order of position."""

    def choose(g: Column) -> Column:
        last = F.size(g) - window

        def winner(j: Column) -> Column:
            seen = [F.get(g, j + k) for k in range(window)]

            def rightmost(least: Column) -> Column:
                at = F.when(F.get(g, j + (window - 1)) == least, j + (window - 1))
                for k in range(window - 2, -1, -1):
                    at = at.when(F.get(g, j + k) == least, j + k)
                return at

            return let(F.least(*seen), rightmost)

        def all_of(least: Column) -> Column:
            found = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(g, i) == least)
            return F.slice(found, -1, 1)

        places = (
            F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), winner)))
            .when(F.size(g) > 0, let(F.array_min(g), all_of))
            .otherwise(F.array().cast("array<int>"))
        )
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.get(g, i).alias("hash")))

    return let(gram_hashes(text, gram), choose)


def likeness(a: Column, b: Column) -> Column:
    """Dice share of two arrays of hashes, taken as sets."""
    sizes = lambda x, y: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(
        2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    )
    return let(F.array_distinct(a), lambda x: let(F.array_distinct(b), lambda y: sizes(x, y)))


def _buckets(docs: DataFrame, rows_each: int) -> tuple[Column, int]:
    """Number of the run of neighbouring doc_ids that a row is in, and how many there are.

    Bounds are quantiles of doc_id: about ``rows_each`` rows a run whatever the ids are.
    They form two levels of at most 256, so a row is placed in a few hundred comparisons.
    """
    rows = docs.agg(F.count("doc_id")).first()[0]
    wide = max(1, min(256, math.ceil(math.sqrt(rows / rows_each))))
    total = wide * wide
    shares = [i / total for i in range(1, total)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10 * total)).first()[0] if shares and rows else []
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0), 1
    coarse = bounds[::wide]
    fine = [bounds[i * wide : (i + 1) * wide] for i in range(len(coarse))]
    over = lambda array: F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    literal = F.array(*[F.array(*[F.lit(b) for b in f]) for f in fine])
    at = let(over(F.array(*[F.lit(b) for b in coarse])), lambda c: F.when(c == 0, 0).otherwise((c - 1) * wide + over(F.get(literal, c - 1))))
    return at, len(bounds) + 1


def _in_run():
    """Neighbours within a run; rows that share a doc_id go by a hash of their text."""
    return W.partitionBy("bucket").orderBy("extra", "doc_id", "tie")


def with_next(docs: DataFrame, rows_each: int = 2_000) -> DataFrame:
    """Each text with that of the next doc_id (of the first after the last) and its bucket.

    Neighbours meet in runs of about ``rows_each`` ids, and each run's first text is also
    dealt to the run before it; the texts are shuffled once.  Rows marked ``extra`` are
    those loans; they close their run and have no next text.
    """
    at, _ = _buckets(docs, rows_each)
    placed = docs.withColumn("bucket", at)
    first = sorted((r.bucket, r.low) for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("low")).collect())  # a row a run
    if not first:
        return placed.withColumns({"extra": F.lit(False), "tie": F.xxhash64("text"), "next_text": F.lit(None).cast("string")})
    to = {low: first[i - 1][0] for i, (_, low) in enumerate(first)}
    pairs = F.array(*[F.struct(F.lit(low).alias("low"), F.lit(b).alias("bucket")) for low, b in to.items()])
    lent = placed.filter(F.col("doc_id").isin(list(to))).withColumn("bucket", F.filter(pairs, lambda p: p["low"] == F.col("doc_id"))[0]["bucket"])
    both = placed.withColumn("extra", F.lit(False)).unionByName(lent.withColumn("extra", F.lit(True)))
    both = both.withColumn("tie", F.xxhash64("text"))
    return both.withColumn("next_text", F.lead("text").over(_in_run()))


def report(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and its edited twin, and how alike they are.

    ``fingerprint`` lists ``position:hash`` of the selected grams (hash in hexadecimal).
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(docs)
    n, cut = F.length("text"), F.floor(F.length("text") / 4)
    edited = F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut.cast("int")))
    shaped = paired.select(
        "doc_id", "bucket", "extra", "tie", n.cast("long").alias("n_chars"),
        F.when(~F.col("extra"), edited).alias("edited"),
        fingerprint(F.col("text"), gram, window).alias("own"),
    )
    shaped = shaped.select(
        "doc_id", "bucket", "extra", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own",
        F.when(~F.col("extra"), fingerprint(F.col("edited"), gram, window)).alias("other"),
    )
    ahead = shaped.withColumn("ahead", F.lead("own.hash").over(_in_run())).filter(~F.col("extra"))
    spelled = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["pos"].cast("string"), F.lit(":"), F.lower(F.hex(p["hash"])))), " ")
    return ahead.select(
        "doc_id", "n_chars", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own.hash"), F.col("other.hash")).alias("near_edited"), likeness(F.col("own.hash"), F.col("ahead")).alias("near_next"),
    )
