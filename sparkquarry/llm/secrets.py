"""Secret scans with multipart credential linking.

Strong kinds stand on their own: ``assign`` (a secret-like name with a value), ``access``
(an access key identifier) and ``hex`` (a long hexadecimal run).  Weak parts say little
alone: an ``id`` (a user, client or account name given a value, or a mail address), a
``secret`` (a long mixed-case token with digits, or what stands behind a user's name in a URL), an ``endpoint`` (a URL or
an address with a port).  Parts become intervals widened by a scope of characters and are joined
where intervals overlap, by searches in the sorted ends of a document's parts (the join never leaves
the document, so it needs no shuffle).  A weak id is reported only with a secret part in its scope, a
weak secret only with an identifier, an endpoint only with one of each.  Access keys count
as identifiers, assignments and hexadecimal runs as secrets.  No part stands for another: what
completes an id or a secret lies outside of it, and of ids and secrets that overlap only the first counts (ids before
secrets, then by place).  An endpoint may hold its own two parts, which lie outside of each other; what lies in an endpoint
is reported beside it.

Texts are scanned whole, as UTF-8 bytes; positions are code points, ends exclusive.

Defined results: a null or empty text has no spans; rows are independent; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.common import slices

#: Code points on either side of a part in which its counterparts are looked for.
SCOPE = 200

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
BASE = KINDS[:3]

# The patterns of the base kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")

# Patterns of the weak parts.
NAMED = re.compile(rb"""\b(?:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.IGNORECASE)
MAIL = re.compile(rb"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LONG = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
LOGIN = re.compile(rb"://([^\s:/@\"'<>]{2,}):([^\s/@\"'<>]{6,})@")
ENDPOINT = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+|\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b")


def _mixed(token: bytes) -> bool:
    """Whether a token has lower case, upper case and digits, none of them rare in it."""
    kinds = (sum(c.islower() for c in map(chr, token)), sum(c.isupper() for c in map(chr, token)), sum(48 <= c <= 57 for c in token))
    return min(kinds) >= 2 and len(set(token)) >= 12


def find_parts(text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and weak parts of a text, in bytes."""
    assigns = b":" in text or b"=" in text
    base: list[tuple[int, int, str]] = []
    if assigns:
        base += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    base += [(*m.span(), "hex") for m in HEX.finditer(text)]
    weak: list[tuple[int, int, str]] = []
    if assigns:
        weak += [(*m.span(), "id") for m in NAMED.finditer(text)]
    if b"@" in text:
        logins = list(LOGIN.finditer(text)) if assigns else []
        weak += [(*m.span(1), "id") for m in logins] + [(*m.span(2), "secret") for m in logins]
        taken = [m.span(2) for m in logins]  # what stands before the @ is no mail address there
        weak += [(*m.span(), "id") for m in MAIL.finditer(text) if not any(a < m.end() and m.start() < b for a, b in _around(taken, m.start(), m.end()))]
    if weak or any(k == "access" for _, _, k in base):  # without an identifier nothing weak is reported
        weak += [(*m.span(), "secret") for m in LONG.finditer(text) if _mixed(m[0])]
        if assigns:
            weak += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)]
    return base, weak


def _around(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Of spans that ascend and do not overlap those that may meet ``[a, b)``."""
    at = bisect_left(spans, (a, a))
    return spans[max(0, at - 1) : bisect_left(spans, (b, b)) + 1]


def linked(base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """The weak parts that have complementary parts within ``scope``.

    A part is in scope if it begins at or after this one's end and at most ``scope`` later, or ends at or before
    its start and at most ``scope`` earlier.  A weak part that lies inside a base span says
    nothing new: it is neither reported nor counted.
    """
    begins = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in begins]
    reach, furthest = [], 0
    for _, b in begins:
        furthest = max(furthest, b)
        reach.append(furthest)

    def inside(a: int, b: int) -> bool:
        at = bisect_left(starts, a + 1) - 1
        return at >= 0 and reach[at] >= b

    weak = [p for p in dict.fromkeys(weak) if not inside(p[0], p[1])]
    weak = sorted([*_apart([p for p in weak if p[2] != "endpoint"]), *(p for p in weak if p[2] == "endpoint")])
    roles = {"assign": "secret", "hex": "secret", "access": "id"}
    by_start: dict[str, list[tuple[int, int]]] = {"id": [], "secret": []}
    for a, b, k in [*base, *weak]:
        if (role := roles.get(k, k)) in by_start:
            by_start[role].append((a, b))
    by_end = {role: sorted((b, a) for a, b in own) for role, own in by_start.items()}
    for own in by_start.values():
        own.sort()

    def near(role: str, a: int, b: int) -> list[tuple[int, int]]:
        own, ends = by_start[role], by_end[role]
        behind = own[bisect_left(own, (b, -1)) : bisect_left(own, (b + scope + 1, -1))]
        before = ends[bisect_left(ends, (a - scope, -1)) : bisect_left(ends, (a + 1, -1))]
        return [*((x, y) for y, x in before), *behind]

    def extent(role: str, a: int, b: int) -> tuple[float, float]:
        """The least end and the greatest start of the parts that lie in an endpoint or its scope."""
        own, ends = by_start[role], by_end[role]
        low = next((y for y, x in islice(ends, bisect_left(ends, (a - scope, -1)), None) if x <= b + scope), inf)
        high = next((x for x, y in islice(reversed(own), len(own) - bisect_left(own, (b + scope + 1, -1)), None) if y >= a - scope), -inf)
        return low, high

    def complete(p: tuple[int, int, str]) -> bool:
        a, b, kind = p
        if kind != "endpoint":
            return bool(near("secret" if kind == "id" else "id", a, b))
        (first_id, last_id), (first_secret, last_secret) = extent("id", a, b), extent("secret", a, b)
        return first_id <= last_secret or first_secret <= last_id

    return [p for p in weak if complete(p)]


def _apart(weak: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without weak parts that overlap a preferred one."""
    order = {"id": 0, "secret": 1}
    kept: list[tuple[int, int]] = []
    out = []
    for p in sorted(dict.fromkeys(weak), key=lambda p: (order[p[2]], p[0], -p[1])):
        at = bisect_left(kept, (p[1], -1))
        if at and kept[at - 1][1] > p[0]:
            continue
        insort(kept, (p[0], p[1]))
        out.append(p)
    return sorted(out)


def _points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte offsets to code points."""
    if text.isascii():
        return spans
    at, seen, to = 0, 0, {}
    for p in sorted({x for a, b, _ in spans for x in (a, b)}):
        seen += len(text[at:p].decode(errors="surrogateescape"))
        at, to[p] = p, seen
    return [(to[a], to[b], k) for a, b, k in spans]


_SPANS = "array<struct<kind: string, start: int, stop: int>>"


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(doc_id, spans)``: base spans and reported weak parts by start, then kind as in KINDS."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out = []
            for value in batch.column("text").cast(pa.binary()):
                text = value.as_py() or b""
                base, weak = find_parts(text)
                spans = []
                if base or weak:
                    spans = _points(text, [*base, *weak])
                    spans = [*spans[: len(base)], *dict.fromkeys(linked(spans[: len(base)], spans[len(base) :], scope))]
                    spans.sort(key=lambda p: (p[0], rank[p[2]], p[1]))
                out.append([{"kind": k, "start": a, "stop": b} for a, b, k in spans])
            made = pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, spans {_SPANS}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans of every document."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
