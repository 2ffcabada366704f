"""Toxicity scoring of noisy-channel restored text.

Leetspeak, spread-out letters and repeated letters are read as noise on words.  A piece
of text that shows such signs becomes a lattice: every sign stands for the letters it
may mean, a run of one letter for one or two of them, a gap between lone letters for
nothing or a word's end.  Viterbi search over the lattice finds the likeliest reading
under a character trigram model, counted over all documents, and the cost of the noise.
Where a word merely has a doubled letter both the word and its reading count, as they do for marks at its edges.

The restored words are scored by stems learned from labels: words and their beginnings
that are found in toxic texts and hardly in others.  A stem's weight is the lower bound
of its precision (Wilson, ``Z`` deviations).  Stems are chosen one after the other, each
for the toxic texts that no earlier one is in, until none has a weight over
``THRESHOLD`` in what is left, and those of a weight over ``SURE`` are added; words that
merely stand near toxic ones are so left out.  A stem found twice or four times in a
text is a stem of its own.  A text's score is the weight of its strongest stem, and near
zero without a stem.

Labels are read from a sample of at most ``LABELLED`` rows, the least by a hash of
doc_id; everything else covers all documents.  The model is a table of 28**3 numbers and
the chosen stems.  Every stem of the sample that has a weight over ``THRESHOLD`` is a candidate; there are no
more of them than the sample's toxic texts have stems that several of them share, so the sample bounds
what the driver holds.

Defined results: null and empty texts have no stem and get the score of texts without
one; texts are scored whole; rows are independent; a doc_id with several labels counts
as toxic if one of them is 1, null labels are left out; without labels no text has a
stem and all scores are 0; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkquarry.llm.bpe import Recent
from sparkquarry.llm.common import held, slices, staged, words

LABELLED = 20_000  # most labelled rows that stems are learned from
SURE = 0.8  # weight with which a stem stays although others cover its texts
TIMES = (1, 2, 4)  # a stem counts anew where a text has it as often
Z = 4.0
THRESHOLD = 0.3
PREFIXES = range(3, 9)
HELD = 100_000  # stems that a counting task holds before it passes their counts on

SIGNS = 28  # 0: none (white space, digits, marks), 1-26: a-z, 27: any other letter

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}

# Costs of the channel, in natural logarithms.
SUBSTITUTE, UNREAD, DROPPED, REPEATED, APART = 0.7, 30.0, 2.5, 1.0, 1.0

_MIXED = re.compile(r"[^\W\d_][^\w\s]*[" + re.escape("".join(LEET)) + r"]+|[" + re.escape("".join(LEET)) + r"]+[^\W\d_]")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_TWICE = re.compile(r"([^\W\d_])\1")
_SPREAD = re.compile(r"(?:[^\W_][.\-_*~]+){2,}[^\W_](?![^\W_])")
_LETTERS = re.compile(r"[^\W\d_]+")


def sign(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 if c.isalpha() else 0


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigrams of signs over all texts, each text between two signs 0."""
    table = np.zeros(256, np.uint8)
    table[128:] = 27
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = np.arange(1, 27)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("trigrams", dict)
        total = np.zeros(SIGNS**3, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), pc.fill_null(batch.column("text"), "")), "\n\n")[0]
            raw = np.frombuffer(b"\n\n" + whole.as_buffer().to_pybytes() + b"\n", np.uint8)
            raw = raw[(raw & 0xC0) != 0x80]  # a code point a sign
            s = table[raw].astype(np.int64)
            total += np.bincount(s[:-2] * SIGNS**2 + s[1:-1] * SIGNS + s[2:], minlength=SIGNS**3)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIGNS**3, dtype=np.int32)), pa.array(total)], names=["gram", "n"])

    grams = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long")
    out = np.zeros(SIGNS**3)
    for gram, n in grams.groupBy("gram").agg(F.sum("n")).collect():  # 28**3 rows, whatever the corpus
        out[gram] = n
    return out


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities ``[a, b, c]`` of sign c after a and b, interpolated over the orders."""
    tri = counts.reshape(SIGNS, SIGNS, SIGNS)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SIGNS)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return -np.log(p3)


class Reader:
    """Finds the likeliest words behind a noisy piece of text."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.read = Recent(self._read, 100_000)

    def _options(self, c: str, run: int, lone: bool) -> list[tuple[str, float]]:
        """What a run of one sign may stand for, with the cost of that noise."""
        if c == " ":
            return [("", 0.0), (" ", APART)] if lone else [(" ", 0.0)]
        if c.isalpha():
            return [(c, 0.0)] if run == 1 else [(c, REPEATED + DROPPED * (run > 2)), (c + c, 0.0 if run == 2 else REPEATED + DROPPED)]
        out = [(x, SUBSTITUTE + REPEATED * (run > 1)) for x in LEET.get(c, "")]
        if c in "il1|!" and run == 2:
            out += [(2 * x, 2 * SUBSTITUTE) for x in LEET.get(c, "")]
        return [*out, (" ", UNREAD if c in LEET else 0.5), *([("", DROPPED)] if c not in LEET else [])]

    def _read(self, piece: str) -> tuple[str, ...]:
        """Viterbi over the lattice of a lower-case piece; states are the last two signs."""
        lone = all(len(x) == 1 for x in piece.split())
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        costs, at = self.costs, 0
        while at < len(piece):
            end = at + 1
            while not lone and end < len(piece) and piece[end] == piece[at]:
                end += 1
            options = self._options(piece[at], end - at, lone)
            at = end
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for letters, noise in options:
                    x, y, now = a, b, cost + noise
                    if letters == " " and y == 0:
                        letters = ""
                    for c in letters:
                        z = sign(c)
                        now += costs[x][y][z]
                        x, y = y, z
                    if (old := step.get((x, y))) is None or now < old[0]:
                        step[x, y] = now, (path, letters) if letters else path
            best = step
        _, path = min(((cost + (costs[a][b][0] if b else 0.0), path) for (a, b), (cost, path) in best.items()), key=lambda s: s[0])
        out = []
        while path is not None:
            path, letters = path
            out.append(letters)
        return tuple("".join(reversed(out)).split())

    def words_of(self, token: str) -> list[str]:
        """The words of one white-space separated token, noise undone."""
        low = token.lower()
        if low.isalpha() and not _THRICE.search(low):
            # A doubled letter may be noise: the word as it stands counts, and so does another reading of it.
            return [low, *(w for w in self.read[low] if w != low)] if _TWICE.search(low) else [low]
        if _SPREAD.search(low):
            return list(self.read[" ".join(c for c in low if c.isalnum() or c in LEET)])
        # Marks at the edges are punctuation before they are letters: both readings count.
        core = low.strip(".,;:!?\"'()[]{}<>«»*_~-")
        out = _LETTERS.findall(low)
        for piece in {low.rstrip(".,;:?\"')]}"), core}:
            if _MIXED.search(piece) or _THRICE.search(piece):
                out += self.read[piece]
        if not out and len(core := low.rstrip(".,;:?\"')]")) >= 3 and len(set(core)) > 1 and all(c in LEET for c in core) and sum(not c.isdigit() for c in core) >= 2:
            out += self.read[core]  # signs only
        return out

    def restore(self, text: str) -> str:
        """A whole text as restored words."""
        out: list[str] = []
        tokens = text.split()
        at = 0
        while at < len(tokens):
            end = at
            while end < len(tokens) and is_lone(tokens[end]):
                end += 1
            if end - at >= 3:
                out += self.read[" ".join(tokens[at:end]).lower()]
                at = end
            else:
                out += self.words_of(tokens[at])
                at += 1
        return " ".join(out)


def is_lone(token: str) -> bool:
    return len(token) == 1 and (token.isalpha() or token in LEET)


def stems_of(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


def marks_of(found: list[str]) -> Iterator[str]:
    """The stems of a text's words, each with the numbers of TIMES that it reaches."""
    own: Counter[str] = Counter()
    for word, n in Counter(found).items():
        for s in stems_of(word):
            own[s] += n
    for s, n in own.items():
        for k in TIMES:
            if n >= k:
                yield f"{k} {s}"


def _sample(labels: DataFrame, allowed: Column) -> DataFrame:
    one = labels.filter(F.col("toxic").isNotNull() & allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(LABELLED)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column) -> dict:
    """The model: trigram costs and weighted stems.  ``allowed`` says which doc_ids' labels may be used."""
    costs = trigram_costs(count_trigrams(docs))
    chosen = F.broadcast(_sample(labels.select("doc_id", "toxic"), allowed))  # LABELLED rows at most
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(chosen, "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("key"), F.xxhash64("text", F.lit("b")).alias("key2")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    shared, token = docs.sparkSession.sparkContext.broadcast(costs), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = held(("stems", token), lambda: Reader(shared.value))
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            names, pairs = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[1] for n in pairs], pa.int64()), pa.array([n[0] for n in pairs], pa.int64())], names=["stem", "bad", "good"])

        for batch in slices(batches, "text", 1 << 20):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts.setdefault("*", [0, 0])[toxic] += 1  # the texts themselves; no stem begins like this
                for s in marks_of(reader.restore(text).split()):
                    counts.setdefault(s, [0, 0])[toxic] += 1
                if len(counts) > HELD:
                    yield flush()
        if counts:
            yield flush()

    sample = texts.select("key", "text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    found = sample.mapInArrow(run, "stem string, bad long, good long")
    found = staged(found.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxicity-stems")
    n, p = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    low = (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    rated = found.filter("bad > 0 and stem <> '*'").withColumn("weight", low).filter(F.col("weight") >= THRESHOLD)
    top = rated.orderBy(F.desc("weight"), F.desc(F.length("stem")), "stem").collect()  # of a bounded sample
    total = found.filter("stem = '*'").collect()
    texts_seen = sum(r.bad + r.good for r in total)
    top = _narrowest(top)
    names = [r.stem for r in top]
    chosen_stems = docs.sparkSession.sparkContext.broadcast({s: i for i, s in enumerate(names)})

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = held(("stems", token), lambda: Reader(shared.value)), chosen_stems.value
        for batch in slices(batches, "text", 1 << 20):
            out = [np.array(sorted({known[s] for s in marks_of(reader.restore(t).split()) if s in known}), "<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["stems"])

    # The toxic texts of the sample, four bytes for each candidate in them.
    bad_texts = sample.filter("toxic = 1").select("text").mapInArrow(hits, "stems binary").collect() if names else []
    return {"costs": costs, "stems": _cover(top, [np.frombuffer(r.stems, "<i4") for r in bad_texts]), "rest": min(THRESHOLD / 3, 1 / (texts_seen + 2)) if texts_seen else 0.0}


def wilson(bad: np.ndarray | int, good: np.ndarray | int) -> np.ndarray | float:
    """Lower bound of the share ``bad / (bad + good)``."""
    n = bad + good
    p = bad / n
    return (p + Z * Z / (2 * n) - Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _narrowest(rated: list) -> list:
    """Without the beginnings that a longer stem stands for: one found in nine tenths of their toxic texts."""
    most: dict[str, int] = {}
    for r in rated:
        times, stem = r.stem.split(" ", 1)
        word = stem.removeprefix("=")
        for k in range(min(PREFIXES), len(word) + stem.startswith("=")):
            short = f"{times} {word[:k]}"
            most[short] = max(most.get(short, 0), r.bad)
    return [r for r in rated if "=" in r.stem or most.get(r.stem, 0) < 0.9 * r.bad]


def _cover(rated: list, texts: list[np.ndarray]) -> dict[str, float]:
    """Stems chosen greedily for the toxic texts that they add; of equals the longer one."""
    out = {r.stem: float(r.weight) for r in rated if r.weight >= SURE}
    if not rated:
        return out
    good = np.array([r.good for r in rated])
    stem = np.concatenate(texts) if texts else np.empty(0, np.int32)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    while len(stem):
        left = np.bincount(stem, minlength=len(rated))
        gain = np.where(left > 0, wilson(np.maximum(left, 1), good), -1.0)
        best = max(np.flatnonzero(gain == gain.max()), key=lambda s: (len(rated[s].stem), rated[s].stem))
        if gain[best] < THRESHOLD:
            break
        out[rated[best].stem] = float(rated[best].weight)
        open_ = np.ones(len(texts), bool)
        open_[text[stem == best]] = False
        stem, text = stem[open_[text]], text[open_[text]]
    return out


class Scorer:
    def __init__(self, model: dict):
        self.rest, self.reader = model["rest"], Reader(model["costs"])
        self.marks: dict[str, list[tuple[int, float]]] = {}
        for mark, weight in model["stems"].items():
            times, stem = mark.split(" ", 1)
            self.marks.setdefault(stem, []).append((int(times), weight))
        self.stems = Recent(lambda token: self.known(self.reader.words_of(token)), 150_000)

    def known(self, found: list[str] | tuple[str, ...]) -> tuple[str, ...]:
        marks = self.marks
        return tuple(s for w in found for s in stems_of(w) if s in marks)

    def score(self, text: pa.Array) -> np.ndarray:
        out = np.full(len(text), self.rest)
        flat, offsets = words(text)
        if not len(flat):
            return out
        coded = flat.dictionary_encode()
        code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        own = [self.stems[w] for w in names]
        hit = np.flatnonzero(np.fromiter(map(bool, own), bool, len(own))[code])
        counts: dict[tuple[int, str], int] = {}
        for doc, c in zip((np.searchsorted(offsets, hit, "right") - 1).tolist(), code[hit].tolist(), strict=True):
            for s in own[c]:
                counts[doc, s] = counts.get((doc, s), 0) + 1
        lone = np.concatenate([[False], np.fromiter(map(is_lone, names), bool, len(names))[code], [False]])
        begins, stops = np.flatnonzero(lone[1:] & ~lone[:-1]), np.flatnonzero(lone[:-1] & ~lone[1:])
        for a, b in zip(begins, stops, strict=True):
            first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b - 1, "right") - 1
            for doc in range(first, last + 1):  # a run of lone letters ends with its text
                x, y = max(a, offsets[doc]), min(b, offsets[doc + 1])
                if y - x >= 3:
                    for s in self.known(self.reader.read[" ".join(names[c] for c in code[x:y]).lower()]):
                        counts[doc, s] = counts.get((doc, s), 0) + 1
        for (doc, s), n in counts.items():
            for times, weight in self.marks[s]:
                if n >= times:
                    out[doc] = max(out[doc], weight)
        return out


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """The rows of ``docs`` with their score in a new column; a column of that name raises ValueError."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already")
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("toxicity", token), lambda: Scorer(shared.value))
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.score(batch.column("text")))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def restore(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, restored)``: the texts as restored words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value["costs"])
        for batch in slices(batches, "text", 2 << 20):
            out = [reader.restore(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, restored string")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction for every document; labels of held-out documents are never read."""
    model = learn(docs, labels, fold(F.col("doc_id")) != 2)
    return score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
