"""Filters and features of nested question samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import text as tx


def is_clean_sentence(sentence: Column) -> Column:
    """60 to 260 characters, no brackets or braces, eight words at least."""
    body = F.trim(sentence)
    return F.length(body).between(60, 260) & ~body.rlike(r"[\[\]{}]") & (F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")) >= 8)


def usable_samples(facts: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples with a question, two support titles at least and some support text.  ``facts(sample_id, title, text)``."""
    good = facts.groupBy("sample_id").agg(F.count_distinct("title").alias("titles"), F.bool_or(F.trim("text") != "").alias("any_text"))
    asked = samples.filter(F.trim("question") != "")
    return asked.join(good.filter("titles >= 2 and any_text"), asked["id"] == good["sample_id"], "left_semi")


def good_samples(facts: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples with a question, an answer that is not yes or no, exactly two support documents and no blank support text."""
    good = facts.groupBy("sample_id").agg(F.count_distinct("title").alias("titles"), F.bool_and(F.trim("text") != "").alias("all_text"))
    asked = samples.filter((F.trim("question") != "") & ~F.lower(F.trim("answer")).isin("yes", "no"))
    return asked.join(good.filter("titles = 2 and all_text"), asked["id"] == good["sample_id"], "left_semi")


def exact_phrase(sentence: Column, title: Column) -> Column:
    """A phrase to look the sentence up by: its longest run of capitalised words other than the title, else the
    best window of six to three tokens (18 to 90 characters, two words that are not stop words; ten points for
    each of those and one a character)."""
    runs = F.filter(F.regexp_extract_all(sentence, F.lit(tx.ENTITY), F.lit(0)), lambda p: F.contains(F.trim(p), F.lit(" ")) & (tx.normalize_text(p) != tx.normalize_text(title)))
    longest = F.array_max(F.transform(runs, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
    tokens = F.filter(F.split(F.trim(sentence), r"\s+"), lambda w: w != "")

    def windows(t: Column) -> Column:
        each = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.slice(t, i, k))
        return F.concat(*[F.filter(each(k), lambda w: F.size(w) == k) for k in (6, 5, 4, 3)])

    def rated(w: Column) -> Column:
        text = F.array_join(w, " ")
        useful = F.size(F.filter(w, lambda x: tx.is_keyword(tx.normalize_text(x))))
        ok = F.length(text).between(18, 90) & (useful >= 2)
        return F.when(ok, F.struct((10 * useful + F.length(text)).alias("score"), text.alias("p")))

    best = tx.let(tokens, lambda t: F.array_max(F.array_compact(F.transform(windows(t), rated))))["p"]
    return F.coalesce(longest, best)


def tool_calls(calls: Column, sequence: Column, rounds: Column) -> Column:
    """The stated number of calls, else the length of the tool sequence, else that of the rounds, else 1."""
    length = lambda c: F.when(F.size(c) > 0, F.size(c))
    return F.coalesce(calls, length(sequence), length(rounds), F.lit(1))


def unanswered(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """What a resumed run still has to do."""
    return questions.join(answered.select("question_id"), "question_id", "left_anti")
