"""Periodic runs in word sequences by heavy/light lag counting.

A run is a maximal stretch of words with smallest period q and length of at least max(12, 2 q).  At lag q
it is an island: ``length - q`` neighbouring positions whose words equal those q further on.

1. How often words match at every lag is counted exactly, in two ways: frequent words of a text by the
   autocorrelation of their places (FFT, rounded to whole numbers), rare ones by the differences
   between their places.  A word is frequent where its pairs would cost more than a transform.
2. Only lags that have as many matches as an island needs are scanned.  Matches inside runs that
   were found at a divisor of the lag are taken off first, so that repetition is scanned once and not at every
   multiple of its period.  (No run that is still unknown loses matches thereby: a window of q words with a period
   that divides q would give its whole run that period.)
3. A scan probes every eighth part of the island's least length, and compares all words only where
   enough neighbouring probes match.

Texts are independent, so a lost task is just run again; memory is that of the longest text.  Counts are exact
for texts of up to some ten million words (the transform's error stays far below one half).

Defined results: a null text counts as empty and has no runs; texts shorter than twelve words have none;
repeated rows and rows that share a doc_id, or have none, are judged each by itself; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import SPACE, joined, let, slices, words

LEAST = 12

#: Pairs that cost as much as one step of a transform.
PAIRS_A_STEP = 0.5

#: Place differences that are held before they are counted.
HELD = 1 << 21

Run = tuple[int, int, int]


def _needed(lag, least: int):
    return np.maximum(least - lag, lag)


def lag_counts(codes: np.ndarray, offsets: np.ndarray, pairs_a_step: float = PAIRS_A_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Matches at every lag up to half a text's length, text after text, and where each text's counts begin.

    The count of lag q of text i is at ``begin[i] + q`` (lag 0 is left empty).
    """
    n = np.diff(offsets)
    half = n // 2
    begin = np.concatenate([[0], np.cumsum(half + 1)])
    out = np.zeros(begin[-1], np.int64)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((codes, text))  # stable: places ascend within a word of a text
    if not len(order):
        return out, begin
    text, codes = text[order], codes[order]
    place = order - offsets[text]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (codes[1:] != codes[:-1])]))
    count = np.diff(np.append(first, len(order)))
    size = 2 ** np.ceil(np.log2(np.maximum(n + half, 2))).astype(np.int64)  # longer than any two places that wrap around
    own = size[text[first]]
    heavy = count * (count - 1) / 2 > pairs_a_step * own * np.log2(own)

    for i in np.unique(text[first[heavy]]).tolist():
        power = np.zeros(size[i] // 2 + 1)
        for g in np.flatnonzero(heavy & (text[first] == i)).tolist():
            at = np.zeros(size[i])
            at[place[first[g] : first[g] + count[g]]] = 1
            spectrum = np.fft.rfft(at)
            power += spectrum.real**2 + spectrum.imag**2
        out[begin[i] + 1 : begin[i] + half[i] + 1] += np.rint(np.fft.irfft(power, size[i])[1 : half[i] + 1]).astype(np.int64)

    light = np.repeat(~heavy, count)
    left = np.repeat(first + count, count) - np.arange(len(order)) - 1  # later places of the same word
    at = np.flatnonzero(light & (left > 0))
    held, n_held, k = [], 0, 1
    while len(at):
        lag = place[at + k] - place[at]
        near = lag <= half[text[at]]
        at, lag = at[near], lag[near]  # what is too far for one is so for all later places
        held.append(begin[text[at]] + lag)
        n_held += len(lag)
        k += 1
        at = at[left[at] >= k]
        if held and (n_held > HELD or not len(at)):
            out += np.bincount(np.concatenate(held), minlength=len(out))
            held, n_held = [], 0
    return out, begin


def _stretches(on: np.ndarray, least: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def islands(codes: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the maximal stretches of at least ``least`` matches at a lag."""
    n, step = len(codes) - lag, max(1, least // 8)
    probed = _stretches(codes[:n:step] == codes[lag::step][: -(-n // step)], least // step)
    if step == 1:
        return probed
    out = []
    for a, b in probed:  # bounded by probes that do not match
        low, high = max(0, (a - 1) * step + 1), min(n, b * step)
        out += [(low + x, low + y) for x, y in _stretches(codes[low:high] == codes[low + lag : high + lag], least)]
    return out


def runs_of(codes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> list[Run]:
    """``(start, length, period)`` by start, then period; ``counts[q]`` has the matches at lag q and is used up."""
    lags = np.arange(len(counts))
    found: dict[tuple[int, int], int] = {}
    for q in (np.flatnonzero(counts[1:] >= _needed(lags[1:], least)) + 1).tolist():
        need = max(least - q, q)
        if counts[q] < need:
            continue
        for a, b in islands(codes, q, need):
            length = b - a + q
            if (a, length) not in found:  # else the period found before divides this one
                found[a, length] = q
                more = np.arange(2 * q, min(len(counts), length), q)
                counts[more] -= length - more
    return sorted((a, length, q) for (a, length), q in found.items())


def runs_of_texts(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, pairs_a_step: float = PAIRS_A_STEP) -> list[list[Run]]:
    counts, begin = lag_counts(codes, offsets, pairs_a_step)
    lag = np.arange(len(counts)) - np.repeat(begin[:-1], np.diff(begin))
    some = np.flatnonzero((lag > 0) & (counts >= _needed(lag, least)))
    out: list[list[Run]] = [[] for _ in range(len(offsets) - 1)]
    for i in np.unique(np.searchsorted(begin, some, side="right") - 1).tolist():
        out[i] = runs_of(codes[offsets[i] : offsets[i + 1]], counts[begin[i] : begin[i + 1]], least)
    return out


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, n_words, runs, text)`` of ``docs(doc_id, text)``.

    ``runs`` has a struct of start, length and period for each run, by start, then period.  The text is what is left
    when of every run only the first period stays: words joined by one space.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["start", "length", "period"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            flat, offsets = words(batch.column("text"))
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = runs_of_texts(codes, offsets, least)
            number = np.array([len(x) for x in found], np.int64)
            rows = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
            begin = np.repeat(offsets[:-1], number) + rows[:, 0]
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, begin + rows[:, 2], 1)
            np.add.at(edge, begin + rows[:, 1], -1)
            keep = np.cumsum(edge[:-1]) == 0
            text = joined(flat.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(keep)])[offsets])
            listed = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields)
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), listed, text], names=["doc_id", "n_words", "runs", "text"])

    struct = ", ".join(f"{f}: bigint" for f in fields)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<{struct}>>, text string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with a repeated stretch written into a tenth of the texts, as the query's contract has it.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10), where h ends in 0 every word from a = g mod n on
    is replaced so that the text goes on with period 1 + floor((n - a) / (3 + g mod 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def written(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1).cast("long")))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        source = lambda i: F.when(i < a, i.cast("long")).otherwise(a + F.pmod(i - a, p)).cast("int")
        return F.array_join(F.transform(w, lambda _, i: F.get(w, source(i))), " ")

    text = F.col("text").cast("string")
    split = F.filter(F.split(text, SPACE), lambda w: w != "")
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, let(split, written)).otherwise(text).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of its runs, the longest one, and digests of all runs and of the text without repetition."""
    found = collapse(with_planted_runs(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
