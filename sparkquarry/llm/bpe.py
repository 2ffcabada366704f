"""BPE encoding and decoding.

Encoding finds, for every start in a word, the longest vocabulary entry with an
Aho-Corasick automaton, takes the longest one whose pairing with the previous token
is one that the merge rules leave standing, and steps back where none is.  The pair
test walks the two tokens' merge trees and is remembered, so it acts as the
pair-compatibility table.  The result is exactly that of applying merges by rank.

Decoding gathers bytes through an offset table, for a whole batch at once.

Defined results: a null or empty text has no ids and decodes to the empty string; texts
are taken whole whatever their length; extra input columns are ignored; rows are
independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import held, slices

#: Words and pre-tokens remembered by a worker in each of two generations.
CACHE = 280_000

# Letters and numbers that the tokenizer library's patterns (Unicode 16) do not know yet,
# and lower-case forms that it knows and this Python (Unicode 15.1) does not.
TOO_NEW = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

END = "\x00"  # stands for the mark of a word's end; never a mapped byte


def _byte_alphabet() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others take the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Recent(dict):
    """A map of bounded size: what was used since the last turn survives a turn."""

    def __init__(self, make, limit: int = CACHE):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Tokenizer:
    """Encoder and decoder of a tokenizer file with a BPE model that marks word ends."""

    def __init__(self, source: str, remembered: int = CACHE):
        import ahocorasick
        import regex

        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        new = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in TOO_NEW.split())
        known = lambda kind: rf"[\p{{{kind}}}--[{new}]]"
        exact = pattern.replace(r"[\p{L}]+", known("L") + "+").replace(r"|[\p{N}]|", "|" + known("N") + "|").replace(r"\p{L}\p{N}]", known("L") + known("N") + "]")
        self.pieces, self.exact_pieces, self.is_new = regex.compile(pattern).findall, regex.compile("(?V1)" + exact).findall, regex.compile(f"[{new}]").search
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.bytes = str.maketrans(dict(enumerate(_byte_alphabet())))
        spell = lambda t: t[: -len(self.suffix)] + END if t.endswith(self.suffix) else t
        self.text = {i: spell(t) for t, i in vocab.items()}
        self.size = {i: len(t) for i, t in self.text.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocab[a + b]: r for r, (a, b) in enumerate(merges)}
        self.split = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        self.pair = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self.machine = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.machine.add_word(t, (len(t), i))
        self.machine.make_automaton()
        self.shorter: dict[int, int] = {}
        known = {t: i for i, t in self.text.items()}
        for i, t in self.text.items():
            self.shorter[i] = next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1)
        self.fits = Recent(self._fits, 3 * remembered)
        self.word_ids = Recent(self._encode_word, remembered)
        self.raw_ids = Recent(self._encode_raw, remembered)
        names = {**vocab, **self.special}
        table = [b""] * (max(names.values()) + 1)
        for t, i in names.items():
            table[i] = t.encode()
        self.names = Offsets(table, b" ")

    def _fits(self, pair: int) -> bool:
        """Whether merging by rank leaves the two tokens side by side.

        Every merge across the border is looked for along the right edge of the left
        token's tree and the left edge of the right one's, later merges undone first.
        """
        left, right = pair >> 20, pair & 0xFFFFF
        rank, split = self.rank, self.split
        bound = len(rank) + 1
        while True:
            joint = self.pair.get((left, right))
            if joint is not None and rank[joint] < bound:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # undone first; of equal ranks the left one was merged first
                bound, left = a, split[left][1]
            else:
                bound, right = b + 1, split[right][0]

    def _encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token by backtracking over longest matches."""
        text = word.encode().decode("latin-1").translate(self.bytes) + END
        n = len(text)
        longest = [-1] * n
        reach = [0] * n
        for stop, (size, token) in self.machine.iter(text):
            start = stop - size + 1
            if size > reach[start]:
                reach[start], longest[start] = size, token
        open_at = [True] * (n + 1)
        open_at[n - 1] = False  # no token starts at the end mark
        out: list[int] = []
        at, token = 0, longest[0]
        size, shorter, fits = self.size, self.shorter, self.fits
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                stop = at + size[token]
                if open_at[stop] and (last < 0 or fits[last << 20 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = stop
                token = longest[at] if at < n else -1
            else:
                open_at[at] = False
                token = out.pop()
                at -= size[token]
        return tuple(out)

    def _encode_plain(self, text: str) -> tuple[int, ...]:
        if text.isascii():
            text = text.lower()
        else:
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text).translate(LOWER))
        found = self.pieces(text) if text.isascii() or not self.is_new(text) else self.exact_pieces(text)
        if len(found) == 1:
            return self.word_ids[found[0]]
        return tuple(i for piece in found for i in self.word_ids[piece])

    def _encode_raw(self, raw: str) -> np.ndarray:
        if self.marks is None or "<" not in raw:
            return np.array(self._encode_plain(raw), np.int32)
        ids: list[int] = []
        for part in self.marks(raw):
            if part:
                ids += [self.special[part]] if part in self.special else self._encode_plain(part)
        return np.array(ids, np.int32)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start and end."""
        # Special marks, combining marks and pre-tokens never reach over ASCII white space.
        split = pc.ascii_split_whitespace(pc.fill_null(text, ""))
        flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        if not len(flat):
            return np.empty(0, np.int32), np.zeros(len(text) + 1, np.int64)
        coded = flat.dictionary_encode()
        raw_ids = self.raw_ids
        table = Offsets.of_arrays([raw_ids[w] for w in coded.dictionary.to_pylist()])
        ids, ends = table.gather(coded.indices.to_numpy())
        return ids, ends[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The tokens' spellings joined by spaces, as for a tokenizer without a decoder."""
        data, ends = self.names.gather(ids)
        first, last = ends[offsets[:-1]], ends[offsets[1:]]
        # Without each row's last separator: rows are cut out of one buffer.
        keep = np.ones(len(data), bool)
        keep[last[last > first] - 1] = False
        sizes = np.where(last > first, last - first - 1, 0)
        stops = np.concatenate([[0], np.cumsum(sizes)])
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(stops.astype(np.int64)), pa.py_buffer(data[keep]))


class Offsets:
    """Values of varying length in one array with the offset of each."""

    def __init__(self, values: list[bytes], end: bytes = b""):
        self.data = np.frombuffer(b"".join(v + end for v in values), np.uint8)
        self.size = np.array([len(v) + len(end) for v in values], np.int64)
        self.start = np.cumsum(self.size) - self.size

    @classmethod
    def of_arrays(cls, values: list[np.ndarray]) -> Offsets:
        out = cls([])
        out.data = np.concatenate(values) if values else np.empty(0, np.int32)
        out.size = np.fromiter(map(len, values), np.int64, len(values))
        out.start = np.cumsum(out.size) - out.size
        return out

    def gather(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``keys`` in a row, and the bounds between them."""
        sizes = self.size[keys]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(self.start[keys] - bounds[:-1], sizes)
        return self.data[np.arange(bounds[-1]) + shift], bounds


def _tokenizer(source: str, remembered: int = CACHE) -> Tokenizer:
    """One tokenizer a Python worker, kept between tasks."""
    return held(("bpe", hash(source), remembered), lambda: Tokenizer(source, remembered))


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False, remembered: int = CACHE) -> DataFrame:
    """``(id, ids array<int>)``, and with ``with_decoded`` also the ``decoded`` text.

    ``remembered`` words (up to a kilobyte each with all tables) are kept by a worker.  The tokenizer file (a few MB, whatever the corpus) is sent once as a broadcast value.
    """
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(_read(tokenizer_path))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + ", decoded string" * with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(source.value, remembered)
        for batch in slices(batches, "text", 2 << 20):
            ids, ends = tok.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            out = [batch.column("id"), lists]
            if with_decoded:
                out.append(tok.decode(ids, ends).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "ids", *["decoded"] * with_decoded])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, decoded string)`` of rows of token ids; a null list decodes to the empty string."""
    spark = encoded.sparkSession
    source = spark.sparkContext.broadcast(_read(tokenizer_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(source.value)
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy().astype(np.int64)
            out = tok.decode(ids.flatten().to_numpy(), ends - ends[0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), out.cast(pa.string())], names=[id_col, "decoded"])

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return encoded.select(F.col(id_col).alias("id"), ids.alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document the number of ids and the SHA-256 of the ids and of the decoded text."""
    coded = encode(docs, tokenizer_path, with_decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
