"""Language-model scoring with an interpolated modified Kneser-Ney n-gram model.

Counting runs in Spark.  Tasks sort and sum the n-grams of their texts, deal them by a
hash of the whole n-gram (so a frequent word or context is spread over all tasks), and
each receiving task sums its part, writes it to the model as sorted hash arrays, and
passes on what the next lower order needs: for each shorter n-gram how many distinct
words precede it, and for each context its total and how many of its words were seen
once, twice, or more often.  Those partial sums are dealt and summed in the same way.

The model is a folder of arrays in the shared folder.  Scoring workers map them into
memory and look sorted batches of hashes up, so they hold pages, not a model.

All orders are estimated from the whole training text; nothing is pruned or sampled.
Discounts come from counts of counts, with 0.5, 1 and 1.5 where those leave no usable
value (very small corpora).  The lowest order is interpolated with a uniform share for
each known token and one for all unknown ones.

Defined results: a null text counts as empty and consists of the end token alone; a
model of no training text gives every token the uniform share; extra columns are
ignored; repeated rows count as often as they occur.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import held, local_path, mix, new_path, slices, word_hashes, words

#: Order of the registered query's model.
ORDER = 2

#: Tokens that a counting task sorts at once.
FLUSH = 2_500_000

#: Bytes of text for each part of the model; a task sums one part at a time, so this bounds its memory.
PART_BYTES = 24 << 20

#: Arrays of a model that a worker maps at a time; the system allows a process some ten thousand.
MAPPED = 4_096

START, END = np.uint64(1), np.uint64(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _chain(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its context and its last word."""
    with np.errstate(over="ignore"):
        return mix(context * _STEP + word)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash; keeps their order."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, each text's end token included, and the texts' offsets."""
    flat, offsets = words(text, lower=True)
    ends = offsets + np.arange(len(offsets))
    tokens = np.full(ends[-1], END, np.uint64)
    real = np.ones(ends[-1], bool)
    real[ends[1:] - 1] = False
    tokens[real] = word_hashes(flat)
    return tokens, ends


def _behind(tokens: np.ndarray, ends: np.ndarray, back: int) -> np.ndarray:
    """The token ``back`` places before each one, or START."""
    out = np.full(len(tokens), START, np.uint64)
    place = np.arange(len(tokens)) - np.repeat(ends[:-1], np.diff(ends))
    at = np.flatnonzero(place >= back)
    out[at] = tokens[at - back]
    return out


def _summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams in the order of their hashes, with their values summed."""
    full = columns[0]
    for c in columns[1:]:
        full = _chain(full, c)
    order = np.argsort(full)
    full = full[order]
    first = np.flatnonzero(np.concatenate([[True], full[1:] != full[:-1]])) if len(full) else np.empty(0, np.int64)
    sums = [np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]
    at = order[first]
    return full[first], [c[at] for c in columns], sums


_ROW = "kind string, part int, grams binary, counts binary"


def _pack(kind: str, full: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], parts: int) -> Iterator[tuple]:
    """Rows for the parts of sorted n-grams; contexts are put side by side, which compresses well."""
    part = _part(full, parts)
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in np.unique(part):
        a, b = edges[p], edges[p + 1]
        order = np.argsort(columns[0][a:b]) + a
        grams = np.concatenate([c[order] for c in columns])
        yield kind, int(p), grams.tobytes(), np.concatenate([v[order] for v in values]).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, parts, grams, counts = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.string()), pa.array(parts, pa.int32()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())], names=["kind", "part", "grams", "counts"]
    )


def _unpack(table: pa.Table, keys: int, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    grams = [np.frombuffer(x.as_buffer(), np.uint64).reshape(keys, -1) for x in table["grams"]]
    counts = [np.frombuffer(x.as_buffer(), np.uint64).reshape(width, -1) for x in table["counts"]]
    return list(np.concatenate(grams, axis=1)), list(np.concatenate(counts, axis=1))


class Store:
    """Arrays in a folder that all machines reach: a mounted path or an Arrow file system."""

    def __init__(self, uri: str):
        self.uri, self.root = uri, local_path(uri)

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def save(self, name: str, array: np.ndarray) -> None:
        """Write under another name and rename, so that a task that runs again does no harm."""
        if self.root:
            os.makedirs(self.root, exist_ok=True)
            with tempfile.NamedTemporaryFile(dir=self.root, delete=False) as file:
                np.save(file, array)
            os.chmod(file.name, 0o644)
            os.replace(file.name, f"{self.root}/{name}.npy")
        else:
            import io

            store, root = self._remote()
            store.create_dir(root, recursive=True)
            data = io.BytesIO()
            np.save(data, array)
            with store.open_output_stream(f"{root}/{name}.npy") as out:
                out.write(data.getvalue())

    def load(self, name: str) -> np.ndarray:
        """The array mapped into memory; from a remote store, through this worker's own temporary folder."""
        if self.root:
            return np.load(f"{self.root}/{name}.npy", mmap_mode="r")
        store, root = self._remote()
        with tempfile.NamedTemporaryFile(suffix=".npy") as file:
            with store.open_input_stream(f"{root}/{name}.npy") as source:
                while chunk := source.read(1 << 24):
                    file.write(chunk)
            file.flush()
            return np.load(file.name, mmap_mode="r")


def _count(order: int, parts: int):
    """Task that counts n-grams of ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*parts_held, strict=True)]
            parts_held.clear()
            full, columns, (n,) = _summed(columns, [np.ones(len(columns[0]), np.uint64)])
            for row in _pack(f"grams{order}", full, columns, [n], parts):
                yield _batch([row])

        for batch in slices(batches, "text", 4 << 20):
            tokens, ends = _tokens(batch.column("text"))
            parts_held.append([*(_behind(tokens, ends, k) for k in range(order - 1, 0, -1)), tokens])
            size += len(tokens)
            if size >= FLUSH:
                yield from flush()
                size = 0
        if parts_held:
            yield from flush()

    return run


def _reduce(level: int, order: int, parts: int, store: Store):
    """Task that sums one part of what has reached ``level``.

    n-grams of that level are written and passed down; contexts of the level above are
    written.  Rows of kind ``stat`` are counts of counts, which Spark sums for the driver.
    """

    def run(table: pa.Table) -> pa.Table:
        kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
        if kind.startswith("stat"):
            return table
        rows: list[tuple] = []
        if kind.startswith("context"):
            (words_,), values = _unpack(table, 1, 4)
            full, _, sums = _summed([words_], values)
            store.save(f"{kind}-{part}", np.stack([full, *sums]))
        else:
            columns, values = _unpack(table, level, 1 if level == order else 2)
            full, columns, sums = _summed(columns, values)
            n, raw = sums[0], sums[-1]
            tally = [np.count_nonzero(n == k) for k in (1, 2, 3, 4)]
            rows.append((f"stat{level}", part, b"", np.array([*tally, n.sum(), len(n), raw.sum()], np.uint64).tobytes()))
            if level == 1:
                store.save(f"grams1-{part}", np.stack([full, n, raw]))
            else:
                big = n >= 255
                store.save(f"grams{level}-{part}", full)
                store.save(f"counts{level}-{part}", np.where(big, 255, n).astype(np.uint8))
                store.save(f"large{level}-{part}", np.stack([full[big], n[big]]))
                lower, low, more = _summed(columns[1:], [np.ones(len(n), np.uint64), raw])
                rows += _pack(f"grams{level - 1}", lower, low, more, parts)
                context = columns[0]
                for c in columns[1:-1]:
                    context = _chain(context, c)
                single = [(n == 1).astype(np.uint64), (n == 2).astype(np.uint64), (n > 2).astype(np.uint64)]
                full, key, sums = _summed([context], [n, *single])
                rows += _pack(f"context{level}", full, key, sums, parts)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of counts, a row for each number."""
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int64)
        each = len(values) // max(1, batch.num_rows)
        kind = batch.column("kind").take(pa.array(np.repeat(np.arange(batch.num_rows), each)))
        yield pa.RecordBatch.from_arrays([kind, pa.array(np.tile(np.arange(each, dtype=np.int32), batch.num_rows)), pa.array(values)], names=["kind", "at", "value"])


def train(docs: DataFrame, order: int = ORDER, text_col: str = "text") -> dict:
    """Count ``docs`` and write the model; returns its description, a few numbers and a path.

    The number of parts grows with the bytes of text, whatever the session's settings; it is the
    session's number of shuffle partitions at least.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    path = new_path(spark, "ngram-model")
    store = Store(path)
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count(order, parts), _ROW)
    for level in range(order, 0, -1):
        rows = rows.groupBy("kind", "part").applyInArrow(_reduce(level, order, parts, store), _ROW)
    found = rows.filter(F.col("kind").startswith("stat")).select("kind", "counts").mapInArrow(_numbers, "kind string, at int, value long")
    stats: dict[int, np.ndarray] = {}
    for kind, at, value in found.groupBy("kind", "at").agg(F.sum("value")).collect():  # seven numbers for each level
        stats.setdefault(int(kind[4:]), np.zeros(7, np.int64))[at] = value
    model = {"path": path, "parts": parts, "order": order, "discounts": {}, "total": 0, "types": 0, "tokens": 0, "singles": [0, 0, 0]}
    for level, s in stats.items():
        model["discounts"][level] = _discounts(*map(int, s[:4]))
    if 1 in stats:
        s = [int(x) for x in stats[1]]
        model |= {"total": s[4], "types": s[5], "tokens": s[6], "singles": [s[0], s[1], s[5] - s[0] - s[1]]}
    return json.loads(json.dumps(model))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    out = [0.5, 1.0, 1.5]
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        if all(0 < d < k + 1 for k, d in enumerate(found)):
            out = found
    return out


class Model:
    """A trained model, mapped into this worker's memory: of its arrays the ``MAPPED`` used last."""

    def __init__(self, spec: dict):
        self.spec, self.store, self.maps = spec, Store(spec["path"]), {}

    def _array(self, name: str) -> np.ndarray | None:
        if name in self.maps:
            self.maps[name] = self.maps.pop(name)  # the last one used
        else:
            try:
                self.maps[name] = self.store.load(name)
            except FileNotFoundError:  # no n-gram fell into this part
                self.maps[name] = None
            if len(self.maps) > MAPPED:
                del self.maps[next(iter(self.maps))]
        return self.maps[name]

    def _find(self, kind: str, hashes: np.ndarray, width: int) -> np.ndarray:
        """Values of sorted distinct hashes, zero where the model has none."""
        out = np.zeros((width, len(hashes)), np.float64)
        edges = np.searchsorted(_part(hashes, self.spec["parts"]), np.arange(self.spec["parts"] + 1))
        for p in np.flatnonzero(np.diff(edges)):
            a, b = edges[p], edges[p + 1]
            known = self._array(f"{kind}-{p}")
            if known is None:
                continue
            keys = known if known.ndim == 1 else known[0]
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == hashes[a:b]) if len(keys) else np.empty(0, np.int64)
            if known.ndim == 2:
                out[:, a + hit] = known[1:, at[hit]]
            else:
                counts = self._array(kind.replace("grams", "counts") + f"-{p}")[at[hit]].astype(np.float64)
                top = np.flatnonzero(counts == 255)
                if len(top):
                    large = self._array(kind.replace("grams", "large") + f"-{p}")
                    counts[top] = large[1][np.searchsorted(large[0], hashes[a:b][hit[top]])]
                out[0, a + hit] = counts
        return out

    def score(self, text: pa.Array) -> dict[str, np.ndarray]:
        """Per text: its tokens, those known, its base score and its log10 probability."""
        spec = self.spec
        tokens, ends = _tokens(text)
        word, code = np.unique(tokens, return_inverse=True)
        adjusted, raw = self._find("grams1", word, 2)
        v, n = spec["types"], spec["tokens"]
        p = np.full(len(word), 1.0 / (v + 1))
        if spec["total"]:
            d = np.array([0.0, *spec["discounts"]["1"]])
            free = np.dot(d[1:], spec["singles"]) / spec["total"]
            p = np.maximum(adjusted - d[np.minimum(adjusted, 3).astype(int)], 0) / spec["total"] + free * p
        p = p[code]
        context = _behind(tokens, ends, 1)
        for k in range(2, spec["order"] + 1):
            d = np.array([0.0, *spec["discounts"].get(str(k), [0.5, 1.0, 1.5])])
            full, at = np.unique(_chain(context, tokens), return_inverse=True)
            seen = self._find(f"grams{k}", full, 1)[0][at]
            full, at = np.unique(context, return_inverse=True)
            total, n1, n2, n3 = self._find(f"context{k}", full, 4)[:, at]
            have = np.flatnonzero(total > 0)
            left = (d[1] * n1 + d[2] * n2 + d[3] * n3)[have]
            p[have] = (np.maximum(seen - d[np.minimum(seen, 3).astype(int)], 0)[have] + left * p[have]) / total[have]
            if k < spec["order"]:
                context = _behind(tokens, ends, k)
                for back in range(k - 1, 0, -1):
                    context = _chain(context, _behind(tokens, ends, back))
        first = ends[:-1]
        base = np.log10((raw + 1) / (n + v + 1))[code]
        return {
            "n_tokens": np.diff(ends),
            "n_known": np.add.reduceat((raw[code] > 0).astype(np.int64), first),
            "base_score": np.add.reduceat(base, first),
            "score": np.add.reduceat(np.log10(p), first),
        }


def score(docs: DataFrame, model: dict, keep: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, *keep, n_tokens, n_known, train_tokens, base_score, score)`` of every document."""
    keep = keep or {}
    frame = docs.select("doc_id", *(c.alias(k) for k, c in keep.items()), F.col("text").cast("string").alias("text"))
    passed = [n for n in frame.columns if n != "text"]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = held(("ngram", model["path"]), lambda: Model(model))
        for batch in slices(batches, "text", 4 << 20):
            found = mapped.score(batch.column("text"))
            own = [batch.column(n) for n in passed]
            total = pa.array(np.full(len(batch), model["tokens"], np.int64))
            values = [pa.array(found["n_tokens"]), pa.array(found["n_known"]), total, pa.array(found["base_score"]), pa.array(found["score"])]
            yield pa.RecordBatch.from_arrays([*own, *values], names=[*passed, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return frame.mapInArrow(run, f"{head}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of all documents under the model of those that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score(docs, train(docs.filter(~held_out), order), {"held_out": held_out})
