"""Fuzzy line dedup, in DataFrame expressions only.

Lines (between line feeds) are normalised: lower case, no ASCII punctuation, one space for
a run of white space (space, 0x09, 0x0B-0x0D), none at the ends.  Equal normalised lines
are one line by 128 bits of hash.  Distinct ones get a 64-bit SimHash of all their words, in which
words of more than ``CONTENT`` letters count ``WEIGHT`` times: shorter ones are much the same in all lines and would make
unlike lines meet.  Lines at most three bits apart agree outside some four of
eight blocks of the hash (pigeonhole over a quadruple system, see ``block_masks``), so they
meet in a join on the rest.  Pairs that meet are compared in full: three bits at most,
then edit similarity in characters.  Connected lines form a group, of which the first
occurrence (least doc_id, then line number) stays.

Lines of one block value do not all meet pairwise: a centre gathers what is similar to it, and
only what is not in its group meets the others (see ``buckets``).  Values that over a
thousand lines share are dealt anew by 48 bits in place of 32.

Defined results: null texts stay null and have no lines; lines of fewer than
``SHORTEST`` normalised characters are never removed; a text whose lines all go becomes
empty and its row stays; rows with one doc_id and unlike texts are documents of their own
in an order by hash, rows alike in both are one document and lose the same lines; a null doc_id
comes before all others; a line of over 5,460 words has a SimHash for each such
block and meets others by any of them; extra columns pass through unless they are called
``_lines``, ``_dropped``, ``_drop`` or ``_row``, which raises ValueError; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.buckets import links_in_buckets
from sparkquarry.llm.common import let, sized, staged
from sparkquarry.llm.components import connected_components

SHORTEST = 20  # normalised characters
RADIUS = 3  # bits
ALIKE = 0.8  # edit similarity: 1 - distance / longer length, in characters
CONTENT, WEIGHT = 4, 3  # letters that a word has to exceed to count so often in the SimHash
SOON = 32  # edits that are tried first

_SEVEN = 7  # words that are added up at once
_MOST = 780 * _SEVEN  # words of a block: counters of 14 bits hold WEIGHT times as many
#: Columns of ours, which ``docs`` cannot have.
NAMES = ("_lines", "_dropped", "_drop", "_row")


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\p{Punct}+", "")  # the ASCII marks


def _spaced(line: Column) -> Column:
    """One space for each run of white space; most lines need nothing done."""
    needs = F.contains(line, F.lit("  "))
    for mark in "\t\x0b\x0c\r":
        needs = needs | F.contains(line, F.lit(mark))
    return F.trim(F.when(needs, F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line))


def normalised(line: Column) -> Column:
    return _spaced(_bare(line))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _majority() -> Column:
    """SimHash from the packed counters ``s0 .. s15`` of words of weight ``n``: lane j of ``sk`` counts bit 16 j + k.

    Adding what half of the weight lacks sets bit 14 of a counter if it counts more than half.
    """
    lanes = F.lit(0x0001000100010001)
    lack = (F.lit((1 << 14) - 1) - F.expr("n div 2")) * lanes
    out = None
    for k in range(16):
        term = F.shiftleft(F.shiftrightunsigned(F.col(f"s{k}") + lack, 14).bitwiseAND(lanes), k)
        out = term if out is None else out.bitwiseOR(term)
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, line, key1, key2, block, sim)`` of every line that is long enough.

    The line is named by 128 bits of its normalised text.  ``sim`` is the SimHash of the words
    of one block of the line; only lines over ``_MOST`` words have blocks after 0.
    """
    named = docs.filter(F.col("text").isNotNull()).select("doc_id", _row_key().alias("row"), _bare(F.col("text")).alias("text"))
    split = named.select("doc_id", "row", F.posexplode(_split(F.col("text"))).alias("line", "own")).filter(F.length("own") >= SHORTEST)
    # From a generator, so that the filter on it does not work it out once more.
    norm = split.select("doc_id", "row", "line", F.explode(F.array(_spaced(F.col("own")))).alias("norm")).filter(F.length("norm") >= SHORTEST)
    keyed = norm.select("doc_id", "row", "line", F.xxhash64("norm").alias("key1"), F.xxhash64("norm", F.lit("second")).alias("key2"), F.split("norm", " ").alias("words"))
    place = ["doc_id", "row", "line", "key1", "key2"]
    seven = keyed.select(*place, "words", F.explode(F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {_SEVEN}"))).alias("part"))
    word = lambda j: F.get("words", F.col("part") * _SEVEN + j)
    hashed = [F.when(word(j).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(word(j))).alias(f"h{j}") for j in range(_SEVEN)]
    long = [F.coalesce(F.length(word(j)) > CONTENT, F.lit(False)).alias(f"g{j}") for j in range(_SEVEN)]
    block = F.expr(f"part div {_MOST // _SEVEN}").cast("int").alias("block")
    each = seven.select(*place, block, F.expr(f"least({_SEVEN}, size(words) - {_SEVEN} * part)").alias("m"), *hashed, *long)
    of_long = [F.when(F.col(f"g{j}"), F.col(f"h{j}")).otherwise(F.lit(0).cast("long")).alias(f"l{j}") for j in range(_SEVEN)]
    extra = sum((F.when(F.col(f"g{j}"), WEIGHT - 1).otherwise(0) for j in range(_SEVEN)), F.col("m"))
    each = each.select(*place, "block", extra.alias("m"), *[f"h{j}" for j in range(_SEVEN)], *of_long)
    # Each bit of seven hashes is added up by full adders: a count in three bits, in ones, twos and fours.
    for x in "hl":
        each = _add(each, (f"{x}0", f"{x}1", f"{x}2"), f"{x}a", f"{x}ca")
        each = _add(each, (f"{x}3", f"{x}4", f"{x}5"), f"{x}b", f"{x}cb")
        each = _add(each, (f"{x}a", f"{x}b", f"{x}6"), f"{x}ones", f"{x}cc")
        each = _add(each, (f"{x}ca", f"{x}cb", f"{x}cc"), f"{x}twos", f"{x}fours")
    lanes = F.lit(0x0001000100010001)
    lane = lambda c, k: F.shiftrightunsigned(c, k).bitwiseAND(lanes)
    count = lambda x, k: lane(f"{x}ones", k) + 2 * lane(f"{x}twos", k) + 4 * lane(f"{x}fours", k)
    sums = [F.sum(count("h", k) + (WEIGHT - 1) * count("l", k)).alias(f"s{k}") for k in range(16)]
    found = each.groupBy(*place, "block").agg(F.sum("m").alias("n"), *sums)
    return found.select(*place, "block", _majority().alias("sim"))


def _add(frame: DataFrame, three: tuple[str, str, str], total: str, carry: str) -> DataFrame:
    """A full adder on every bit of three columns, which are replaced by their sum and carry."""
    a, b, c = (F.col(x) for x in three)
    both = frame.withColumn("_x", a.bitwiseXOR(b))
    both = both.withColumns({carry: a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(F.col("_x"))), total: F.col("_x").bitwiseXOR(c)})
    return both.drop("_x", *three)


def block_masks(power: int) -> list[int]:
    """Masks of which at least one leaves out any three bits.

    The 64 bits are cut into ``2**power`` blocks.  The quadruples of block numbers whose exclusive or is zero
    hold every three blocks in exactly one of them; a mask leaves out the four of one: 14 masks of 32 bits for
    eight blocks, 140 of 48 bits for sixteen.
    """
    blocks = 1 << power
    size = 64 // blocks
    quads = [q for q in combinations(range(blocks), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]
    masks = [(1 << 64) - 1 - sum(((1 << size) - 1) << size * b for b in q) for q in quads]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key1, norm)`` of the lines that ``wanted(key1, doc_id, row, line)`` names."""
    per_doc = wanted.groupBy("row").agg(F.collect_list(F.struct("line", "key1")).alias("_lines"))
    per_doc = sized(staged(per_doc, "lines-fetch"), "size(_lines)")
    got = docs.select(_row_key().alias("row"), "text").join(per_doc, "row")
    pick = let(_split(F.col("text")), lambda own: F.transform("_lines", lambda x: F.struct(x["key1"].alias("key1"), F.get(own, x["line"]).alias("own"))))
    got = got.select(F.explode(pick).alias("x")).select("x.key1", normalised(F.col("x.own")).alias("norm"))
    return got.filter(F.xxhash64("norm") == F.col("key1")).dropDuplicates(["key1"])


def _similar(pairs: DataFrame) -> DataFrame:
    """The pairs of lines ``_a`` and ``_b`` that are within the edit distance allowed.

    The words that both begin and end with are left out first.  Every word counts with the space
    behind it, which changes no distance.
    """
    first = "cast(array_position(zip_with({0}, {1}, (p, q) -> coalesce(p = q, false)), false) as int)"
    rest = "reverse(slice({0}, {1}, greatest(size({0}) - {1} + 1, 0)))"
    spelled = "array_join(transform(" + rest + ", w -> concat(w, ' ')), '')"
    steps = [
        {"_most": f"cast(floor(greatest(length(_a), length(_b)) * {round(1 - ALIKE, 6)} + 1e-9) as int)", "_x": "split(_a, ' ')", "_y": "split(_b, ' ')"},
        {"_n": first.format("_x", "_y")},
        {"_x": rest.format("_x", "_n"), "_y": rest.format("_y", "_n")},
        {"_n": "coalesce(nullif(" + first.format("_x", "_y") + ", 0), 1)"},
        {"_x": spelled.format("_x", "_n"), "_y": spelled.format("_y", "_n")},
    ]
    pairs, done = pairs.filter(F.col("_a") != F.col("_b")), ()
    for step in steps:  # each in a generator of its own, or the optimizer would put one step into the other, over and over
        kept = [c for c in ("u", "v", "_a", "_b", "_most", "_x", "_y", "_n") if c in pairs.columns and c not in step and c not in done]
        pairs = pairs.select(*kept, F.explode(F.array(F.struct(*[F.expr(e).alias(k) for k, e in step.items()]))).alias("_s")).select(*kept, "_s.*")
        done = ("_a", "_b")
    # A larger allowance costs more, so most pairs are settled by a small one.
    tries = [f"levenshtein(_x, _y, least(_most, {SOON * 8**k})) >= 0" for k in range(3)] + ["levenshtein(_x, _y, _most) >= 0"]
    close = tries[-1]
    for k in (2, 1, 0):
        close = f"{tries[k]} or _most > {SOON * 8**k} and ({close})"
    return pairs.filter(f"abs(length(_x) - length(_y)) <= _most and ({close})").select("u", "v")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(u, v)`` links between near lines; ``distinct(key1, doc_id, row, line, sim)`` has each line once."""

    def keyed(rows: DataFrame, power: int) -> DataFrame:
        each = rows.select("id", "sim", F.posexplode(F.array(*[F.lit(m) for m in block_masks(power)])).alias("choice", "mask"))
        return each.select(F.xxhash64("choice", F.expr("sim & mask")).alias("bucket"), "id", "sim")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = staged(pairs.select(F.col("u").alias("key1")).union(pairs.select("v")).distinct(), "lines-ids")
        wanted = staged(distinct.join(sized(ids), "key1").select("key1", "row", "line").dropDuplicates(["key1"]), "lines-wanted")
        texts = sized(staged(_texts(docs, wanted), "lines-text"), "1 + length(norm) div 64")
        both = pairs.join(texts.select(F.col("key1").alias("u"), F.col("norm").alias("_a")), "u").join(texts.select(F.col("key1").alias("v"), F.col("norm").alias("_b")), "v")
        return _similar(both)

    rows = distinct.select(F.col("key1").alias("id"), "sim")
    power = 3 if distinct.count() <= 1 << 28 else 4  # what meets by chance stays a small share; the result is the same
    return links_in_buckets(keyed(rows, power), f"bit_count(a_sim ^ b_sim) <= {RADIUS}", verify, "lines", lambda crowd: keyed(crowd, 4))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``(row, drop array<int>)``: the numbers of the lines to remove, from 0, of the documents named by ``row``."""
    lines = staged(line_table(docs), "lines")
    found = lines.groupBy("key1", "key2", "block").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count("*").alias("n"), F.min("sim").alias("sim"))
    found = staged(found, "lines-distinct")
    groups = found.filter("block = 0").select("key1", "key2", "first", "n")
    links = near_lines(docs, found.select("key1", "first.doc_id", "first.row", "first.line", "sim"))
    parts = staged(connected_components(links, "lines-groups").select(F.col("node").alias("key1"), "component"), "lines-members")
    near = staged(groups.join(sized(parts), "key1").select("key1", "key2", "component", "first"), "lines-near")
    keep = staged(near.groupBy("component").agg(F.min("first").alias("keep")), "lines-first")
    near = near.join(sized(keep), "component").select("key1", "key2", "keep")
    again = groups.filter("n > 1").join(near.select("key1", "key2"), ["key1", "key2"], "left_anti").select("key1", "key2", F.col("first").alias("keep"))
    gone = lines.filter("block = 0").join(sized(staged(near.union(again), "lines-keep")), ["key1", "key2"]).filter("row <> keep.row or line <> keep.line")
    return gone.groupBy("row").agg(F.collect_set("line").alias("drop"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated lines cut out of ``text``; adds ``_lines`` and ``_dropped``, their numbers."""
    if taken := {c.lower() for c in docs.columns} & set(NAMES):
        raise ValueError(f"columns {sorted(taken)} are named like this operator's own")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    drop = staged(dropped_lines(docs.select("doc_id", "text")), "lines-drop").select(F.col("row").alias("_row"), F.col("drop").alias("_drop"))
    both = docs.withColumn("_row", _row_key()).join(sized(drop, "size(_drop)"), "_row", "left").drop("_row")
    rest = F.array_join(F.filter(_split(F.col("text")), lambda x, i: ~F.array_contains("_drop", i)), "\n")
    out = both.withColumn("_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(_split(F.col("text")))).cast("long"))
    out = out.withColumn("_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
    return out.withColumn("text", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(rest)).drop("_drop")


def report(docs: DataFrame) -> DataFrame:
    """Per document its lines, those removed, and a digest of what is left (of the empty text for null)."""
    cut = without_repeated_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return cut.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
