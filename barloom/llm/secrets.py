"""Secrets in texts: fixed patterns, and multipart credentials whose parts stand near each other.

An access identifier, a secret and an endpoint are each weak evidence. One pass over the texts finds all parts; an
interval join within scopes (blocks between blank lines) then reports a weak part only where a complementary part
lies within `gap` code points, and which parts make up a credential. The join is a nearest-neighbour sweep: it costs a sort, not pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

# The kinds in the order in which spans with the same start are listed, the certain ones first.
BASE = ("assign", "access", "hex")
LINKED = ("linked_id", "linked_secret", "linked_endpoint")
KINDS = BASE + LINKED

# Patterns of the certain kinds; the number is the fewest characters (of group 2 for assign).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Patterns of parts that say little alone.
WEAK = (
    ("linked_id", re.compile(r"""(?i:client_?id|user_?name|user|login|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{4,})""", re.ASCII)),
    ("linked_secret", re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}", re.ASCII)),
    ("linked_endpoint", re.compile(r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?i:host|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.ASCII)),
)
BLANK = re.compile(r"\n[\x20\t\r]*\n")
HINT = re.compile(r"[0-9:=]")


def parts(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, end, kind number, scope) of all parts; the certain kinds leftmost and non-overlapping within a kind."""
    if not text or not HINT.search(text):  # each kind needs a digit, a colon or an equals sign, but for letters alone, below
        return [(m.start(), m.end(), k, 0) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text or "") if m.end() - m.start() >= LEAST[KINDS[k]]]
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    certain = sorted((s, e) for s, e, _ in found)
    for kind, pattern in WEAK:
        at = 0
        for m in pattern.finditer(text):
            while at < len(certain) and certain[at][1] <= m.start():
                at += 1
            if not (at < len(certain) and certain[at][0] < m.end()):
                found.append((m.start(), m.end(), KINDS.index(kind)))
    if not found:
        return []
    ends = [m.end() for m in BLANK.finditer(text)]
    found.sort()
    out, scope = [], 0
    for s, e, k in found:
        while scope < len(ends) and ends[scope] <= s:
            scope += 1
        out.append((s, e, k, scope))
    return out


#: The part a kind can play in a credential.
ROLE = {"access": "id", "linked_id": "id", "assign": "secret", "hex": "secret", "linked_secret": "secret", "linked_endpoint": "endpoint"}
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
CREDENTIAL = pa.list_(pa.struct([(f"{role}_{place}", pa.int64()) for role in ("id", "secret", "endpoint") for place in ("start", "end")]))


def neighbours(found: list[tuple[int, int, int, int]], role: str, gap: int) -> list[int]:
    """For each of the parts, sorted and of one scope: the nearest other part with that role within `gap` code points, or -1.

    The interval join of the parts with themselves, as one sweep: what ends last before a part, and what starts next after it.
    Overlapping parts are at no distance; of equally near ones the earlier is taken.
    """
    after, nearest = [-1] * len(found), -1
    for i in range(len(found) - 1, -1, -1):
        after[i] = nearest
        if ROLE[KINDS[found[i][2]]] == role:
            nearest = i
    out, before = [], -1
    for i, (s, e, k, _) in enumerate(found):
        best, least = -1, gap + 1
        if before >= 0 and s - found[before][1] < least:
            best, least = before, max(0, s - found[before][1])
        if after[i] >= 0 and found[after[i]][0] - e < least:
            best = after[i]
        out.append(best)
        if ROLE[KINDS[k]] == role and (before < 0 or e >= found[before][1]):
            before = i
    return out


def linked(text: str | None, gap: int) -> tuple[list[tuple[int, int, int]], list[tuple[int | None, ...]]]:
    """(spans, credentials) of a text: the certain parts and the weak ones that a complementary part supports; and for each secret its identifier and endpoint."""
    found = sorted(parts(text), key=lambda p: (p[3], p[0], p[1], p[2]))
    spans, credentials = [], []
    at = 0
    while at < len(found):
        to = at
        while to < len(found) and found[to][3] == found[at][3]:
            to += 1
        scope = found[at:to]
        with_id, with_secret, with_end = (neighbours(scope, role, gap) for role in ("id", "secret", "endpoint"))
        for i, (s, e, k, _) in enumerate(scope):
            role = ROLE[KINDS[k]]
            supported = with_id[i] >= 0 or with_end[i] >= 0 if role == "secret" else with_secret[i] >= 0
            if k < len(BASE) or supported:
                spans.append((s, k, e))
            if role == "secret" and supported:
                place = lambda x: scope[x][:2] if x >= 0 else (None, None)
                credentials.append((*place(with_id[i]), s, e, *place(with_end[i])))
        at = to
    return sorted(spans), credentials


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gap: int = 256) -> DataFrame:
    """(id, spans, credentials): for every input row its spans array<struct<start, kind, end>>, by start, kind as in KINDS, end.

    Offsets are code points, end exclusive. Certain kinds are always there. A weak identifier needs a secret (certain
    or weak) within `gap` in its scope; a weak secret needs an identifier or an endpoint; an endpoint needs a secret.
    A credential is a secret with the nearest identifier and endpoint within `gap`, either of which may be NULL.
    Links never leave a text, so all is one pass without a shuffle. Repeated and NULL ids keep a row each. A NULL or
    empty text has no spans. Columns other than id and text are ignored.
    """
    kept = docs.schema[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, credentials = [], []
            for t in texts(b, 1):
                s, c = linked(t, gap)
                spans.append([dict(zip(("start", "kind", "end"), x)) for x in s])
                credentials.append([dict(zip((f.name for f in CREDENTIAL.value_type), x)) for x in c])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPAN), pa.array(credentials, CREDENTIAL)], names=[doc_id, "spans", "credentials"])

    of = ",".join(f"{f.name}:bigint" for f in CREDENTIAL.value_type)
    ddl = f"`{doc_id}` {kept.dataType.simpleString()}, spans array<struct<start:bigint,kind:int,end:bigint>>, credentials array<struct<{of}>>"
    return docs.select(doc_id, F.col(text).cast("string").alias("_text_")).mapInArrow(run, ddl)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: str | None, mark: str, gap: int) -> str | None:
    spans = linked(text, gap)[0]
    if not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if end > at:
            out += [] if start < at else [text[at:start], mark]
            at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]", gap: int = 256) -> DataFrame:
    """`docs` with its spans replaced by `mark`; overlapping spans get one mark. Rows, repeated ones too, and all other columns stay; a NULL text stays NULL. One pass, no shuffle."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([redacted(t, mark, gap) for t in texts(b, place)], b.schema.types[place])
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
