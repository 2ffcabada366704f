"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

Fingerprints are 64-bit SimHashes of word shingles.  Two that differ in at most three
bits meet on a variant that is one flip away from one and at most two flips away from
the other, so every fingerprint emits the variants of half the radius (one flip) and,
for the odd middle, pairs of flips.  Two facts keep the pairs few:

* fingerprints three bits apart have unlike parity, so only odd ones emit pairs;
* of three flipped bits two lie in the same half of the word, so only such pairs count
  (992 in place of 2,016).

All fingerprints within one flip of a variant are linked to each other and to all that
reach it with two flips.  One link from each to the smallest of the former therefore
loses no link's component, and a variant gathers 65 + 992 fingerprints at most,
whatever the data.  Fingerprints that share no three of six blocks with any other have
no neighbour (pigeonhole) and emit nothing.  Copies collapse to one fingerprint first.

``similar_groups`` serves a similarity of word shingles in place of a number of bits.  Texts at similarity
0.8 are about ten bits apart, out of reach of balls of such a radius, so it works in two steps.
First the balls: SimHashes of the distinct shingles meet as above, and what meets is verified by its sets of shingles;
that joins the closest copies.  Then an exact step for the rest: of two sets with Jaccard
similarity s or more, put in one common order, the first n - ceil(s n) + 1 elements of each share
one (prefix filter), and enough of both has to be left at the first they share (position filter).  Texts meet in
a join on those shingles, and the sets of what meets and is not joined already are compared.  The order is by hash, with
shingles that a sample of documents shows to be common at the end; the sample changes the cost and not the
result.  Only texts with equal sets of shingles collapse.

Defined results: a null text counts as empty; a text without words has fingerprint
zero; fewer words than a shingle form one shingle; repeated rows share a fingerprint;
an empty table gives no rows; extra columns are ignored.  In ``similar_groups`` rows that share a doc_id
are linked to what any of their texts is like, and a row without a doc_id has no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.buckets import links_in_buckets
from sparkquarry.llm.common import mix, sized, slices, staged, words
from sparkquarry.llm.components import connected_components

RADIUS = 3
SHINGLE = 3

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: bytes | np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer at once (as published, little endian)."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    four = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))
    size = size.astype(np.int64)
    at = start.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        seed_ = np.uint64(seed)
        h = np.full(len(at), seed_ + _P5, np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = [np.full(len(long), x, np.uint64) for x in (seed_ + _P1 + _P2, seed_ + _P2, seed_, seed_ - _P1)]
            stripes = size[long] // 32
            order = np.argsort(-stripes, kind="stable")
            ends = np.searchsorted(-stripes[order], -np.arange(1, stripes.max() + 1), side="right")
            for k, n in enumerate(ends):
                on = order[:n]
                spot = at[long[on]] + 32 * k
                for j in range(4):
                    lanes[j][on] = _round(lanes[j][on], eight[spot + 8 * j])
            acc = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                acc = (acc ^ _round(np.uint64(0), lane)) * _P1 + _P4
            h[long] = acc
            at[long] += stripes * 32
        h += size.astype(np.uint64)
        left = size % 32
        for k in range(3):
            on = np.flatnonzero(left >= 8 * (k + 1))
            h[on] = _turn(h[on] ^ _round(np.uint64(0), eight[at[on] + 8 * k]), 27) * _P1 + _P4
        at += left // 8 * 8
        left = left % 8
        on = np.flatnonzero(left >= 4)
        h[on] = _turn(h[on] ^ (four[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[on] += 4
        left = left % 4
        for k in range(3):
            on = np.flatnonzero(left > k)
            h[on] = _turn(h[on] ^ (raw[at[on] + k].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        return h ^ (h >> np.uint64(32))


def simhash(text: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprints of an array of texts, a row of one each."""
    hashes, grams = _hashes(text, shingle)
    out, full = np.zeros(len(text), np.uint64), np.flatnonzero(grams)
    if len(full):
        out[full] = _majority(hashes, (np.cumsum(grams) - grams)[full], grams[full])
    return out[:, None]


def _hashes(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, one text after the other, and their number in each text."""
    flat, offsets = words(text, lower=True)
    count = np.diff(offsets)
    grams = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    if not len(flat):
        return np.empty(0, np.uint64), grams
    size = pc.binary_length(flat).to_numpy().astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")[0].as_buffer()
    bounds = np.concatenate([[0], np.cumsum(grams)])
    first = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], grams)
    last = np.minimum(first + shingle - 1, np.repeat(offsets[1:] - 1, grams))
    return xxh64(data, begin[first], begin[last] + size[last] - begin[first]), grams


def shingle_sets(text: pa.Array, shingle: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles and their number; those in ``common`` (sorted) come last, else they ascend."""
    hashes, grams = _hashes(text, shingle)
    row = np.repeat(np.arange(len(grams)), grams)
    hashes = hashes[np.lexsort((hashes, row))]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = hashes[np.lexsort((late, row))]
    return hashes, np.bincount(row, minlength=len(grams))


def _majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits set in over half the hashes of each run."""
    ones = np.zeros((len(starts), 64), np.int64)
    step = 1 << 19  # hashes unpacked at a time
    for a in range(0, len(hashes), step):
        b = min(a + step, len(hashes))
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low, high = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        ones[low:high] += np.add.reduceat(bits, np.maximum(starts[low:high] - a, 0), axis=0, dtype=np.int32)
    most = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp long)``: the SimHash of every text, as the signed value of its 64 bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(simhash(batch.column("text"), shingle)[:, 0].view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _block_masks(blocks: int = 6, kept: int = 3) -> list[int]:
    """Masks of every choice of ``kept`` of ``blocks`` blocks of the 64 bits."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    return [_signed(sum(part[i] for i in chosen)) for chosen in combinations(range(blocks), kept)]


def _ball() -> list[int]:
    return [0, *(_signed(1 << i) for i in range(64))]


def _pairs() -> list[int]:
    return [_signed(1 << i | 1 << j) for low in (0, 32) for i, j in combinations(range(low, low + 32), 2)]


def _with_company(nodes: DataFrame) -> DataFrame:
    """The fingerprints that agree with another one in three of six blocks."""
    masks = F.array(*[F.lit(m) for m in _block_masks()])
    keyed = nodes.select("node", "fp", F.posexplode(masks).alias("choice", "mask")).select("node", "fp", "choice", F.expr("fp & mask").alias("part"))
    shared = keyed.groupBy("choice", "part").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("choice", "part")
    return keyed.join(shared, ["choice", "part"], "left_semi").select("node", "fp").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """``(u, v)`` links whose components are those of all pairs within three bits.

    ``nodes(node, fp)`` has each fingerprint once.
    """
    near = staged(_with_company(nodes), "simhash-near")
    wide = F.array(*[F.lit(m) for m in _ball()])
    pairs = F.array(*[F.lit(m) for m in _pairs()])
    one = near.select(F.struct("node", "fp").alias("own"), F.explode(wide).alias("flip"), F.lit(True).alias("hub"))
    two = near.filter("bit_count(fp) % 2 = 1").select(F.struct("node", "fp").alias("own"), F.explode(pairs).alias("flip"), F.lit(False).alias("hub"))
    variants = one.union(two).select(F.expr("own.fp ^ flip").alias("variant"), "own", "hub")
    met = variants.groupBy("variant").agg(F.min(F.when(F.col("hub"), F.col("own"))).alias("centre"), F.collect_list("own").alias("members"))
    met = met.filter("centre is not null and size(members) > 1").select("centre", F.explode("members").alias("own"))
    checked = met.filter(f"own.node <> centre.node and bit_count(own.fp ^ centre.fp) <= {RADIUS}")
    return checked.select(F.col("own.node").alias("u"), F.col("centre.node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp long, component_id)``; the component is the smallest doc_id reachable
    over links of at most three differing bits, the document's own included."""
    prints = staged(fingerprints(docs, shingle=shingle), "simhash")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    groups = connected_components(links(nodes), "simhash-links")
    label = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint in hexadecimal and its component."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A shingle is common if that many documents of the sample (one in ``SAMPLED``) have it; so many are known at most.
COMMON, SAMPLED, KNOWN = 2, 8, 1_000_000


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that are better compared last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            hashes, _ = shingle_sets(batch.column("text"), shingle, np.empty(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h long")
    found = staged(some.groupBy("h").agg(F.count("*").alias("n")).filter(f"n >= {COMMON}"), "similar-common")
    # The most frequent by their counts: neither rows nor a sort of them reach the driver, only the hashes as one Arrow column.
    counts = sorted(found.groupBy("n").agg(F.count("*").alias("hashes")).collect(), key=lambda r: -r.n)  # a row for each count there is
    least, known = 0, 0
    for row in counts:
        known += row.hashes
        if known > KNOWN:
            least = row.n
            break
    hashes = found.filter(F.col("n") > least).select("h").toArrow().column("h").to_numpy()
    return np.sort(hashes.astype(np.int64).view(np.uint64))


def _shingles(text: str, shingle: int):
    low = "(lower(coalesce(%s, '')))" % text
    parts = rf"filter(split({low}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    each = f"transform(sequence(1, size(w) - {shingle - 1}), i -> xxhash64(array_join(slice(w, i, {shingle}), ' ')))"
    return F.expr(f"array_distinct(transform(array({parts}), w -> if(size(w) >= {shingle}, {each}, array(xxhash64(array_join(w, ' ')))))[0])")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)``: components over pairs whose sets of word shingles have that Jaccard similarity."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))  # KNOWN numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            hashes, n = shingle_sets(batch.column("text"), shingle, common.value)
            start = np.cumsum(n) - n
            full = np.flatnonzero(n)
            keys = np.zeros((3, len(n)), np.uint64)
            if len(full):
                for k, salt in enumerate((_P1, _P2)):
                    keys[k, full] = np.add.reduceat(mix(hashes ^ salt), start[full])
                keys[2, full] = _majority(hashes, start[full], n[full])
            size = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
            ends = np.cumsum(size)
            prefix = hashes[np.arange(ends[-1]) + np.repeat(start - (ends - size), size)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(prefix.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(k.view(np.int64)) for k in keys), pa.array(n.astype(np.int32)), lists], names=["doc_id", "key1", "key2", "fp", "n", "prefix"])

    prints = staged(docs.mapInArrow(run, f"doc_id {kind}, key1 long, key2 long, fp long, n int, prefix array<long>"), "similar-sets-of")
    key = ["key1", "key2", "n"]
    nodes = staged(prints.groupBy(*key).agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "similar-nodes")
    copies = prints.select("doc_id", *key).join(sized(staged(nodes.filter("rows > 1"), "similar-copied")), key).filter("doc_id <> node").select("doc_id", *key).distinct()
    near = prints.filter("doc_id is not null").join(sized(staged(copies, "similar-copies")), ["doc_id", *key], "left_anti")

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
        sets = docs.join(sized(staged(ids, "similar-ids")), "doc_id").distinct().select("doc_id", _shingles("text", shingle).alias("s"))
        sets = sized(staged(sets, "similar-sets"), "1 + size(s) div 3")
        both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("_a")), "u").join(sets.select(F.col("doc_id").alias("v"), F.col("s").alias("_b")), "v")
        both = both.filter(f"least(size(_a), size(_b)) >= {similarity} * greatest(size(_a), size(_b)) - 1e-9")
        common = F.size(F.array_intersect("_a", "_b"))
        return both.filter(common >= similarity * (F.size("_a") + F.size("_b") - common) - 1e-9).select("u", "v").distinct()

    points = staged(near.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "similar-points")
    same = near.filter("n > 0").select("doc_id", "fp").join(sized(staged(points.filter("rows > 1"), "similar-same")), "fp").filter("doc_id <> node")
    met = staged(links(points.select("node", "fp")).union(same.select(F.col("doc_id").alias("u"), F.col("node").alias("v"))), "similar-met")
    close_copies = staged(verify(met), "similar-balls")
    keyed = near.select(F.posexplode("prefix").alias("pos", "bucket"), "doc_id", "n").select("bucket", F.col("doc_id").alias("id"), F.struct("n", "pos").alias("sim"))
    # The sets share as many as both have from the first that they share, at most; so many they need.
    needed = f"{similarity / (1 + similarity)} * (a_sim.n + b_sim.n) - 1e-6"
    close = f"least(a_sim.n, b_sim.n) >= {similarity} * greatest(a_sim.n, b_sim.n) - 1e-9 and least(a_sim.n - a_sim.pos, b_sim.n - b_sim.pos) >= {needed}"
    found = links_in_buckets(keyed, close, verify, "similar", given=close_copies)
    groups = connected_components(found, "similar-links")
    label = nodes.join(sized(staged(groups, "similar-groups")), "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    return prints.select("doc_id", *key).join(sized(staged(label, "similar-label")), key).select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
