"""Checks of questions as arrays of issue codes; every check is an expression over the question's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.functions import text as tx

# Word lists, months and issue codes.
LOOKUP_WORDS = (
    "document", "file", "record", "entry", "article", "page", "corpus",
)
HOP_FORBIDDEN = (
    "document", "file", "evidence", "sentence", "passage", "source", "article",
)
FACT_FORBIDDEN = (*HOP_FORBIDDEN, "text", "according to", "rewrite", "fact")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan\\.?|Feb\\.?|Mar\\.?|Apr\\.?|Jun\\.?|Jul\\.?|Aug\\.?|Sep\\.?|Sept\\.?|Oct\\.?|Nov\\.?|Dec\\.?"
DATE = rf"\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b"
DEFINITIONS = ("what is ", "what is the ", "what was ", "what was the ", "who is ", "who was ")
RELATION_WORDS = r"\b(who|what|which|where|when|whose|that|from|by|of)\b"


def _codes(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in sorted(checks.items())]))


def basic(question: Column, lookup: bool = False) -> Column:
    """Sorted codes; an empty question has that one issue only."""
    body = F.regexp_replace(question, r"^\s+|\s+$", "")
    low = F.lower(body)
    checks = {
        "missing_question_mark": ~F.endswith(body, F.lit("?")), "question_too_short": F.length(body) < 25, "question_too_long": F.length(body) > 240,
        "contains_newline": body.rlike(r"[\n\r]"), "instruction_like_question": low.rlike("^(rewrite|write|generate) "),
    }
    if not lookup:
        checks["contains_file_or_evidence_language"] = tx.forbidden_term(body, HOP_FORBIDDEN)
    return F.when(body == "", F.array(F.lit("empty_question"))).otherwise(_codes(checks))


def preferred_anchor(subtype: Column, anchor: Column, sentence: Column) -> Column:
    """For dates the first full date in the sentence that contains the anchor, else the anchor."""
    dates = F.filter(F.regexp_extract_all(sentence, F.lit(DATE), F.lit(0)), lambda d: tx.normalized_contains(d, anchor))
    return F.when((subtype == "date_number_lookup") & (F.trim(anchor) != ""), F.coalesce(F.get(dates, F.lit(0)), F.trim(anchor))).otherwise(F.trim(anchor))


def _sorted(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def semantic(rows: DataFrame) -> Column:
    """Issues of ``question`` against ``gold_title`` and ``gold_sentence``."""
    q, title = F.col("question"), tx.normalize_text(F.col("gold_title"))
    asked = tx.normalize_text(q)
    defined = F.lit(False)
    for start in DEFINITIONS:
        defined = defined | F.startswith(asked, F.concat(F.lit(start), title))
    rest = F.size(F.array_except(tx.content_words(asked), tx.content_words(title)))
    q_words, s_words = tx.content_words(q), tx.content_words(F.col("gold_sentence"))
    share = F.size(F.array_intersect(q_words, s_words)) / F.greatest(F.size(q_words), F.lit(1))
    comparable = (F.size(q_words) >= 5) & (F.size(s_words) > 0)
    own = _codes({
        "semantic_question_uses_file_or_rewrite_language": tx.forbidden_term(q, FACT_FORBIDDEN), "semantic_question_is_title_definition": (title != "") & defined & (rest <= 1),
        "question_copies_gold_sentence_too_closely": comparable & (share >= 0.78), "question_has_too_little_overlap_with_gold_sentence": comparable & (share <= 0.10),
    })
    return _sorted(basic(q), own)


def exact(rows: DataFrame) -> Column:
    """Issues of a lookup ``question`` by ``subtype``, ``anchor_value``, ``gold_title`` and ``gold_sentence``."""
    q, kind, title, anchor = F.col("question"), F.col("subtype"), F.col("gold_title"), F.col("anchor_value")
    low = F.lower(q)
    looks = F.lit(False)
    for w in LOOKUP_WORDS:
        looks = looks | F.contains(low, F.lit(w))
    named = tx.normalized_contains(q, title)
    lookup = kind.isin("date_number_lookup", "exact_phrase_lookup")
    known = _codes({
        "boilerplate_evidence_template": F.contains(low, F.lit("evidence needed to answer")) | F.contains(low, F.lit("evidence related to")), "missing_file_lookup_language": ~looks,
        "missing_required_anchor": ~tx.normalized_contains(q, preferred_anchor(kind, anchor, F.col("gold_sentence"))),
        "anchor_not_in_gold_sentence": (kind != "title_anchor") & (anchor != "") & ~tx.normalized_contains(F.col("gold_sentence"), anchor),
        "title_anchor_missing_gold_title": (kind == "title_anchor") & ~named, "non_title_lookup_leaks_gold_title": lookup & named,
        "exact_phrase_not_quoted": (kind == "exact_phrase_lookup") & ~F.contains(q, F.lit('"')),
    })
    unknown = F.when(~lookup & (kind != "title_anchor"), F.array(F.concat(F.lit("unknown_exact_subtype:"), kind))).otherwise(F.array().cast("array<string>"))
    return _sorted(basic(q, lookup=True), known, unknown)


def multi_hop(rows: DataFrame) -> Column:
    """Issues of a ``question`` by ``answer``, ``gold_doc_ids`` (joined by a bar) and ``gold_sentences`` (by two)."""
    q, answer = F.col("question"), F.col("answer")
    parts = lambda c, mark: F.size(F.filter(F.split(c, mark), lambda x: F.trim(x) != ""))
    own = _codes({
        "multi_hop_requires_exactly_two_gold_documents": parts("gold_doc_ids", r"\|") != 2, "multi_hop_requires_at_least_two_gold_sentences": parts("gold_sentences", r"\|\|") < 2,
        "empty_answer": F.trim(answer) == "", "answer_leaked_in_question": (F.trim(answer) != "") & tx.normalized_contains(q, answer),
        "question_has_weak_relation_signal": ~F.lower(q).rlike(RELATION_WORDS),
    })
    return _sorted(basic(q), own)


def preflight(rows: DataFrame) -> Column:
    """Whether the anchor of a lookup gives its title away."""
    kind, title = F.col("subtype"), F.col("gold_title")
    wide = preferred_anchor(kind, F.col("anchor_value"), F.col("gold_sentence"))
    leaks = kind.isin("date_number_lookup", "exact_phrase_lookup") & (tx.normalized_contains(F.col("anchor_value"), title) | tx.normalized_contains(wide, title))
    return _codes({"anchor_leaks_gold_title": leaks})


def repair_status(issues: Column, verified: Column, attempts: Column, most: int = 3, hopeless: Column | None = None) -> Column:
    """Status of a question in the repair loop: accepted, dropped (nothing to repair it from), retried, or left for review."""
    drop = F.lit(False) if hopeless is None else hopeless
    return F.when(drop, "drop").when((F.size(issues) == 0) & verified, "accepted").when(attempts < most, "retry").otherwise("needs_review")
