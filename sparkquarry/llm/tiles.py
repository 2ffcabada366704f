"""Near-duplicate embeddings by products of int8 tiles with rigorous error bounds.

Vectors are compared where their labels are equal.  Each is scaled to length one and rounded to int8 steps of its own
size; how far the rounded vector is from the true one is measured and kept with it.  With u and v the unit vectors, p and q
what they were rounded to,

    | u v - p q |  <=  |p| |v - q| + |u - p|

so a product of int8 tiles, which is exact in whole numbers, proves of nearly all pairs that they are above the
threshold or below.  Only tile pairs that hold a pair open to doubt are fetched again with full vectors, and there only the
pairs in doubt are computed anew, in double precision.

Vectors that are equal collapse to one, with a count, before anything is compared.  A label's vectors are dealt
evenly by hash to tiles of about ``TILE``, and a task has one pair of tiles at a time, so neither memory nor the size of
a task depends on how many rows a label has.  Of a pair of tiles only sums leave the task: how many links each
vector has, and links enough (two for a row at most) to keep what is connected connected.  Every pair is thus compared and none is
emitted as such.

Defined results: vectors that are null, empty or zero or hold null or non-finite entries, and rows without a label or
a vec_id, link with nothing (the component is the own vec_id); vectors of unlike lengths do not link;
repeated rows and rows that share a vec_id are vectors like others and link with each other if near enough; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import sized, staged
from sparkquarry.llm.components import connected_components

THRESHOLD = 0.93

#: Vectors of a tile, on average.
TILE = 4_096

#: Rows of a tile that are multiplied at a time, and dimensions whose int8 products are exact in single precision.
STRIP, EXACT_DIMS = 512, 1_024

#: More than what rounding of bounds and scales in double precision can amount to.
SLACK = 1e-9

_KEY = ["label", "dims"]
_NAME = [*_KEY, "key1", "key2"]


def _coded(rows: DataFrame) -> DataFrame:
    """Every row with its int8 form; ``dims`` is 0 and the form null where it links with nothing."""
    kinds = dict(rows.dtypes)
    single = kinds["embedding"] == "array<float>"
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    width = np.dtype("<f4" if single else "<f8")
    named = rows.select(
        "vec_id", "label", F.xxhash64("label", vector).alias("key1"), F.xxhash64(F.lit(1), vector, "label").alias("key2"),
        F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), vector).alias("embedding"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [_form(v, width) for v in _vectors(batch.column("embedding"))]
            dims, codes, step, error, full = zip(*forms, strict=True) if forms else [()] * 5
            names = ["vec_id", "label", "key1", "key2"]
            columns = [pa.array(dims, pa.int32()), pa.array(codes, pa.binary()), pa.array(step, pa.float64()), pa.array(error, pa.float64()), pa.array(full, pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *columns], names=[*names, "dims", "codes", "step", "error", "full"])

    return named.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, key1 long, key2 long, dims int, codes binary, step double, error double, full binary")


def _vectors(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows' entries; an empty array for a null row, NaN for a null entry."""
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    size[column.is_null().to_numpy(zero_copy_only=False)] = 0
    yield from np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)[:-1]) if len(size) else ()


def _form(v: np.ndarray, width: np.dtype) -> tuple:
    """``(dims, codes, step, error, full)`` of one vector."""
    if not v.size or not np.isfinite(v).all() or not v.any():
        return 0, None, None, None, None
    unit = _unit(v)
    step = float(np.abs(unit).max() / 127)
    codes = np.rint(unit / step).astype(np.int8)
    return len(v), codes.tobytes(), step, float(np.linalg.norm(unit - codes * step)) + SLACK, v.astype(width).tobytes()


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors (in the last axis) at length one; scaled first, so that squares neither vanish nor overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


class _Tile:
    """One side of a tile pair: ``list<struct<node, n, codes, step, error, full>>`` of one row."""

    def __init__(self, rows: pa.StructArray, dims: int, full: bool, width: np.dtype):
        column = lambda name: rows.field(name)
        self.node = column("node")
        self.n, self.step, self.error = (column(x).to_numpy(zero_copy_only=False) for x in ("n", "step", "error"))
        self.codes = np.frombuffer(b"".join(column("codes").to_pylist()), np.int8).reshape(-1, dims).astype(np.float32)
        self.length = self.step * np.linalg.norm(self.codes.astype(np.float64), axis=1)
        self.full = _unit(np.frombuffer(b"".join(column("full").to_pylist()), width).reshape(-1, dims)) if full else None


def _candidates(a: _Tile, b: _Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, sure)`` of all pairs that may reach the threshold, a strip of rows at a time."""
    widest, longest = b.step.max(), b.error.max()
    for s in range(0, len(a.n), STRIP):
        strip = slice(s, s + STRIP)
        if a.codes.shape[1] <= EXACT_DIMS:
            whole = a.codes[strip] @ b.codes.T  # whole numbers below 2^24: exact
        else:
            whole = sum((a.codes[strip, d : d + EXACT_DIMS] @ b.codes[:, d : d + EXACT_DIMS].T).astype(np.float64) for d in range(0, a.codes.shape[1], EXACT_DIMS))
        least = threshold - SLACK - a.error[strip] - a.length[strip] * longest
        least = np.where(least > 0, least / (a.step[strip] * widest) * (1 - 1e-6), -np.inf)
        i, j = np.nonzero(whole >= least[:, None].astype(whole.dtype))
        near = whole[i, j] * a.step[i + s] * b.step[j]
        i = i + s
        bound = a.length[i] * b.error[j] + a.error[i] + SLACK
        may = near + bound >= threshold
        yield i[may], j[may], (near - bound >= threshold)[may]


def _joined(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the least index of each group) after joining u with v."""
    while len(u):
        a, b = labels[u], labels[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def _compared(pairs: DataFrame, threshold: float, width: np.dtype, doubtful: bool) -> DataFrame:
    """What tile pairs come to: rows of degrees (u, n), links (u, v) and, unless ``doubtful``, marks of pairs in doubt."""
    node = pairs.schema["a"].dataType.elementType["node"].dataType.simpleString()
    label = pairs.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                dims, i, j = (row.column(x)[0].as_py() for x in ("dims", "i", "j"))
                a, b = (_Tile(row.column(x).flatten(), dims, doubtful, width) for x in ("a", "b"))
                one = i == j
                nodes = a.node if one else pa.concat_arrays([a.node, b.node])
                shift = 0 if one else len(a.n)
                degree, labels, doubt = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), False
                for p, q, sure in _candidates(a, b, threshold):
                    other = (p != q) if one else np.ones(len(p), bool)
                    if doubtful:
                        at = np.flatnonzero(other & ~sure)
                        good = np.zeros(len(p), bool)
                        for c in range(0, len(at), STRIP * 64):
                            part = at[c : c + STRIP * 64]
                            good[part] = np.einsum("ij,ij->i", a.full[p[part]], b.full[q[part]]) >= threshold
                    else:
                        good = other & sure
                        doubt = doubt or bool((other & ~sure).any())
                    p, q = p[good], q[good]
                    degree[: len(a.n)] += np.bincount(p, b.n[q], len(a.n)).astype(np.int64)
                    if not one:
                        degree[shift:] += np.bincount(q, a.n[p], len(b.n)).astype(np.int64)
                    labels = _joined(labels, p, q + shift)
                linked, moved = np.flatnonzero(degree), np.flatnonzero(labels != np.arange(len(labels)))
                u = pa.concat_arrays([nodes.take(pa.array(linked)), nodes.take(pa.array(moved)), nodes.slice(0, int(doubt))])
                none = pa.nulls(1, nodes.type).slice(0, int(doubt))
                v = pa.concat_arrays([pa.nulls(len(linked), nodes.type), nodes.take(pa.array(labels[moved])), none])
                n = pa.concat_arrays([pa.array(degree[linked]), pa.nulls(len(moved), pa.int64()), pa.nulls(int(doubt), pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [u, v, n, pa.repeat(row.column("label")[0], len(u)), *(pa.array(np.full(len(u), x, np.int32)) for x in (dims, i, j))],
                    names=["u", "v", "n", "label", "dims", "i", "j"],
                )

    return pairs.select(*_KEY, "i", "j", "a", "b").mapInArrow(run, f"u {node}, v {node}, n long, label {label}, dims int, i int, j int")


def _pairs(tiles: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Every pair of tiles of a label once (or those in ``wanted``), each in a row of its own that is dealt by the pair."""
    a = tiles.select(*_KEY, F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("j"), F.col("rows").alias("a"))
    b = tiles.select(*_KEY, F.explode(F.expr("sequence(0, tile)")).alias("i"), F.col("tile").alias("j"), F.col("rows").alias("b"))
    key = [*_KEY, "i", "j"]
    if wanted is not None:
        a, b = (x.join(wanted, key, "left_semi") for x in (a, b))
    return a.join(b.hint("merge"), key)


def similar(rows: DataFrame, threshold: float = THRESHOLD, tile: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id)`` for every row of ``rows(vec_id, embedding, label)``.

    ``n_links`` counts the other vectors of equal label at that cosine or more; the component is the smallest
    vec_id that links reach.  ``threshold`` has to be above 0.
    """
    tile = tile or TILE
    width = np.dtype("<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8")
    coded = staged(_coded(rows), "tiles-coded")
    valid = coded.filter("dims > 0")
    copied = valid.groupBy(*_NAME).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    copied = staged(copied, "tiles-copied")
    few = sized(copied)
    # Of equal vectors one stands for all; the others are gone before anything is dealt by label.
    form = ["codes", "step", "error", "full"]
    single = valid.join(few, _NAME, "left_anti").select(*_NAME, F.col("vec_id").alias("first"), F.lit(1).cast("long").alias("n"), *form)
    several = valid.join(few, _NAME).groupBy(*_NAME).agg(F.min("first").alias("first"), F.max("copies").alias("n"), *[F.first(c).alias(c) for c in form])
    nodes = single.union(several).select(*_KEY, F.struct(F.col("first").alias("vec_id"), "key1").alias("node"), "key1", "n", *form)
    nodes = staged(nodes, "tiles-nodes")
    sizes = nodes.groupBy(*_KEY).agg(F.count("*").alias("size")).filter("size > 1").select(*_KEY, F.expr(f"cast(ceil(size / {tile}) as int)").alias("tiles"))
    dealt = nodes.join(sized(staged(sizes, "tiles-sizes")), _KEY).withColumn("tile", F.expr("cast(pmod(xxhash64(key1), tiles) as int)"))
    gathered = lambda frame, *more: frame.groupBy(*_KEY, "tile", "tiles").agg(F.collect_list(F.struct("node", "n", "codes", "step", "error", *more)).alias("rows"))

    found = staged(_compared(_pairs(gathered(dealt)), threshold, width, False), "tiles-found")
    doubt = staged(found.filter("n is null and v is null").select(*_KEY, "i", "j"), "tiles-doubt")
    if doubt.take(1):
        met = doubt.select(*_KEY, F.explode(F.array("i", "j")).alias("tile")).distinct()
        again = gathered(dealt.join(sized(staged(met, "tiles-met")), [*_KEY, "tile"], "left_semi"), "full")
        found = found.union(staged(_compared(_pairs(again, sized(doubt)), threshold, width, True), "tiles-again"))
    degrees = staged(found.filter("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links")), "tiles-degrees")
    groups = staged(connected_components(found.filter("v is not null").select("u", "v"), "tiles-links"), "tiles-groups")
    about = sized(staged(degrees.join(groups, "node", "left").select("node", "links", F.col("component.vec_id").alias("reached")), "tiles-about"))

    every = coded.select("vec_id", *_NAME).join(few, _NAME, "left")
    every = every.withColumn("node", F.when(F.col("dims") > 0, F.struct(F.coalesce("first", "vec_id").alias("vec_id"), "key1")))
    return every.join(about, "node", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.coalesce("reached", "node.vec_id")).alias("component_id"),
    )


def report(rows: DataFrame) -> DataFrame:
    """Per vector its links, its component and whether it stands for that component."""
    return similar(rows).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
