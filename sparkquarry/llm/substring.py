"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

The reference is the corpus without its repeats: a block, a sequence of ``window`` words, is
indexed at its first place, the first document and there the first position in which it
starts.  So a block has one place, and the longest match at a place is the only one.  Every
document is parsed greedily from left to right: where the block at hand is indexed in an earlier
document, the factor runs on as long as the next blocks follow in the reference, and
the parse goes on behind its last word.  The blocks across that boundary, which begin inside the
factor and end behind it, are looked up as well and give factors of their own, so no repeat that
straddles factors is missed.  Words under a factor are duplicate spans.

Indexing every block of a corpus would shuffle a row a word.  Blocks therefore first
meet on their minimiser (the least hash of the 25-word grams inside), of which a text
has one for about every 13 words: a block can only repeat if its minimiser does in
another document.  Documents with the same words are one document here, the first;
later copies are one factor from end to end.  What is joined is written before, so that both sides
of a join are bare shuffles and adaptive execution can split the partitions of hot blocks.

Defined results: a null text counts as empty; a text shorter than a window loses
nothing; windows never cross documents; rows that share a doc_id are told apart by
their texts and are no references of each other, rows alike in both lose the same words; a row without a doc_id
loses nothing and is no reference; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import joined, mix, sized, slices, staged, word_hashes, words

WINDOW = 50

#: Odd multipliers of two rolling hashes; a block is known by both, 128 bits in all.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _rolled(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of each run of ``length`` neighbouring values, by a rolling polynomial modulo 2**64."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes) - 1, base, np.uint64)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up)])
        return mix((total[length:] - total[:n]) * down)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` neighbouring values."""
    out, have = values, 1
    while 2 * have <= span:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = span - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Of every block of ``window`` words the least hash of its grams, in text order."""
    gram = (window + 1) // 2
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    return _least(_rolled(hashes, gram, BASES[0]), window - gram + 1)


def _kind(frame: DataFrame, name: str) -> str:
    return frame.schema[name].dataType.simpleString()


def _named(docs: DataFrame) -> DataFrame:
    """``(doc, text)``: rows under their doc_id and a hash of their text."""
    text = F.col("text").cast("string")
    return docs.select(F.struct("doc_id", F.xxhash64(text).alias("row")).alias("doc"), text.alias("text"))


def _outline(docs: DataFrame, window: int) -> DataFrame:
    """Per document: 128 bits over its words, how many there are, and its distinct minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            flat, offsets = words(batch.column("text"))
            hashes = word_hashes(flat)
            least = _minimisers(hashes, window)
            keys = np.zeros((2, len(batch)), np.uint64)
            marks, count = [], np.zeros(len(batch) + 1, np.int64)
            with np.errstate(over="ignore"):
                place = mix(np.arange(1, np.diff(offsets).max(initial=0) + 1, dtype=np.uint64))
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    own = hashes[a:b]
                    keys[0, i] = np.bitwise_xor.reduce(mix(own + place[: b - a]), initial=np.uint64(0))
                    keys[1, i] = np.sum(mix(own ^ place[: b - a]), dtype=np.uint64)
                    if b - a >= window:
                        marks.append(np.unique(least[a : b - window + 1]))
                        count[i + 1] = len(marks[-1])
            flat_marks = np.concatenate(marks) if marks else np.empty(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(count).astype(np.int32)), pa.array(flat_marks.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array(np.diff(offsets)), lists],
                names=["doc", "key1", "key2", "n_words", "marks"],
            )

    return docs.mapInArrow(run, f"doc {_kind(docs, 'doc')}, key1 long, key2 long, n_words long, marks array<long>")


def _blocks(texts: DataFrame, window: int) -> DataFrame:
    """``(block1, block2, doc, pos)`` of every block whose minimiser is among the document's ``marks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            flat, offsets = words(batch.column("text"))
            hashes = word_hashes(flat)
            least = _minimisers(hashes, window)
            first, second = (_rolled(hashes, window, b) for b in BASES)
            marks, ends = batch.column("marks").flatten().to_numpy().view(np.uint64), batch.column("marks").offsets.to_numpy()
            ends = ends - ends[0]
            rows, places = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if b - a >= window:
                    at = np.flatnonzero(np.isin(least[a : b - window + 1], marks[ends[i] : ends[i + 1]]))
                    rows.append(np.full(len(at), i))
                    places.append(at)
            row = np.concatenate(rows) if rows else np.empty(0, np.int64)
            place = np.concatenate(places) if places else np.empty(0, np.int64)
            at = offsets[row] + place
            yield pa.RecordBatch.from_arrays(
                [pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64)), batch.column("doc").take(pa.array(row)), pa.array(place.astype(np.int32))],
                names=["block1", "block2", "doc", "pos"],
            )

    return texts.mapInArrow(run, f"block1 long, block2 long, doc {_kind(texts, 'doc')}, pos int")


def parse(pos: np.ndarray, place: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, bool]]:
    """The greedy parse of one document: ``(start, length, at, boundary)``, ``at`` being the index of the factor's first block.

    ``pos`` ascends and holds the positions whose blocks are indexed; ``place`` numbers their places in the
    reference so that neighbours differ by one.
    """
    new = np.flatnonzero((np.diff(pos, prepend=pos[0] - 2) != 1) | (np.diff(place, prepend=place[0]) != 1))
    starts, stops = pos[new].tolist(), pos[np.append(new[1:], len(pos)) - 1].tolist()  # runs that follow the reference
    out: list[tuple[int, int, int, bool]] = []
    at, k = starts[0], 0
    while True:
        stop = stops[k]
        out.append((at, stop - at + window, int(new[k]) + at - starts[k], False))
        behind = stop + window  # where the parse goes on
        k += 1
        while k < len(starts) and starts[k] < behind:  # blocks across the boundary
            last = min(stops[k], behind - 1)
            out.append((starts[k], last - starts[k] + window, int(new[k]), True))
            if stops[k] >= behind:
                break
            k += 1
        if k == len(starts):
            return out
        at = max(starts[k], behind)


def _parsed(found: DataFrame, window: int) -> DataFrame:
    """The factors of every document from its indexed blocks, a document at a time."""
    sorted_ = found.repartition("doc").sortWithinPartitions("doc", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the document that the last batch ended with

        def factors_of(table: pa.Table) -> pa.RecordBatch:
            pos, ref_pos = table["pos"].to_numpy().astype(np.int64), table["ref_pos"].to_numpy().astype(np.int64)
            row, ref = _numbers(table["doc"]), _numbers(table["ref"])
            jump = np.concatenate([[0], np.cumsum(np.diff(ref) != 0)]) << 32  # another reference document, another place
            edges = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
            out, at = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own = parse(pos[a:b], (jump + ref_pos)[a:b], window)
                out += own
                at += [a + x[2] for x in own]
            cut = table.take(pa.array(at, pa.int64()))
            starts, lengths, _, edge = zip(*out, strict=True)
            columns = [cut["doc"].combine_chunks(), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32()), cut["ref"].combine_chunks(), cut["ref_pos"].combine_chunks(), pa.array(edge)]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "start", "length", "ref", "ref_start", "boundary"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            last = _numbers(pa.chunked_array([batch.column("doc")]))
            same = int(np.flatnonzero(last != last[-1])[-1]) + 1 if (last != last[-1]).any() else 0
            if len(held) > 1 and held[-2]["doc"][-1] != held[-1]["doc"][0]:  # the document held ended with its batch
                yield factors_of(pa.concat_tables(held[:-1]))
                held = held[-1:]
            if same:
                rest = held.pop()
                yield factors_of(pa.concat_tables([*held, rest.slice(0, same)]))
                held = [rest.slice(same)]
        if held:
            yield factors_of(pa.concat_tables(held))

    kind = _kind(found, "doc")
    return sorted_.mapInArrow(run, f"doc {kind}, start int, length int, ref {kind}, ref_start int, boundary boolean")


def _numbers(docs: pa.ChunkedArray) -> np.ndarray:
    """A number for each row's document; neighbours of one document have one."""
    flat = docs.combine_chunks()
    parts = [x.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat.flatten()]
    return parts[0] * (parts[1].max(initial=0) + 1) + parts[1]


def factors(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The parse of ``docs(doc_id, text)``.

    First ``(doc, start, length, ref, ref_start, boundary)``: the factors in words, none
    shorter than ``window``; ``boundary`` marks those looked up across the end of another.  Then
    ``(doc, copy_of)``: documents of at least ``window`` words that have the same words as an earlier one;
    they are one factor each and not listed in the first.  ``doc``, ``ref`` and ``copy_of`` are
    ``(doc_id, row)``, the latter a hash of the text.
    """
    docs = _named(docs).filter("doc.doc_id is not null")
    outline = staged(_outline(docs, window), "substring-outline").filter(f"n_words >= {window}")
    first = outline.groupBy("key1", "key2").agg(F.min("doc").alias("copy_of"), F.max("doc.doc_id").alias("last")).filter("copy_of.doc_id < last")
    first = sized(staged(first.drop("last"), "substring-first"))
    copies = outline.select("doc", "key1", "key2").join(first, ["key1", "key2"]).filter("doc.doc_id > copy_of.doc_id").select("doc", "copy_of")
    copies = staged(copies.distinct(), "substring-copies")
    marks = outline.join(sized(copies.select("doc")), "doc", "left_anti").select("doc", F.explode("marks").alias("mark"))
    shared = marks.groupBy("mark").agg(F.min("doc.doc_id").alias("a"), F.max("doc.doc_id").alias("b")).filter("a < b").select("mark")
    # Merged at every size: these tables grow with the corpus, and so does what is shuffled.
    wanted = marks.join(staged(shared, "substring-shared").hint("merge"), "mark").groupBy("doc").agg(F.collect_set("mark").alias("marks"))
    blocks = staged(_blocks(docs.join(staged(wanted, "substring-marks").hint("merge"), "doc"), window), "substring-blocks")
    index = blocks.groupBy("block1", "block2").agg(F.min(F.struct("doc", "pos")).alias("place"), F.max("doc.doc_id").alias("last")).filter("place.doc.doc_id < last")
    index = staged(index.select("block1", "block2", F.col("place.doc").alias("ref"), F.col("place.pos").alias("ref_pos")), "substring-index")
    found = blocks.join(index.hint("merge"), ["block1", "block2"]).filter("ref.doc_id < doc.doc_id").select("doc", "pos", "ref", "ref_pos").distinct()
    return _parsed(found, window), copies


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each text's words outside all factors, joined by one space."""
    kind = _kind(docs, "doc_id")
    found, copies = factors(docs, window)
    spans = found.select("doc", F.struct("start", "length").alias("span")).union(
        copies.select("doc", F.struct(F.lit(0).alias("start"), F.lit(-1).alias("length")).alias("span"))
    )
    spans = staged(spans.groupBy("doc").agg(F.collect_list("span").alias("spans")), "substring-spans")
    cut = _named(docs).join(spans.hint("merge"), "doc", "left")
    cut = cut.select("doc.doc_id", "text", F.coalesce("spans.start", F.array().cast("array<int>")).alias("starts"), F.coalesce("spans.length", F.array().cast("array<int>")).alias("lengths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            flat, offsets = words(batch.column("text"))
            edge = np.zeros(len(flat) + 1, np.int64)
            starts, lengths = batch.column("starts"), batch.column("lengths")
            ends = starts.offsets.to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            size = lengths.flatten().to_numpy()
            begin = offsets[row] + starts.flatten().to_numpy()
            stop = np.where(size < 0, offsets[row + 1], begin + size)
            np.add.at(edge, begin, 1)
            np.add.at(edge, stop, -1)
            keep = np.cumsum(edge[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            total = np.diff(offsets)
            text = joined(flat.filter(pa.array(keep)), kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total), pa.array(total - np.diff(kept)), text], names=["doc_id", "n_words", "n_removed", "kept"])

    return cut.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
