"""Benchmark decontamination by q-gram lemma filtering.

Benchmark passages are cut into segments that overlap by half. A text that holds a segment of n characters within k
edits shares at least n - q + 1 - k*q of its q-grams with it, on diagonals at most k apart. So shared q-grams are
counted in overlapping diagonal bands; bands with enough of them are regions, and a banded alignment verifies each.
Passages too short for edits are looked for as they are, at word borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the first, hashed look-up (a power of two), and odd multipliers of the q-gram hashes.
SLOT_BITS = 22
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
ODD_32 = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 and not 0xD800 <= i < 0xE000 else i for i in range(65536)], dtype=np.uint32)
LOWER_BYTES = LOWER[:256].astype(np.uint8).tobytes()


@dataclass(frozen=True)
class Rules:
    """q of the q-grams, edits allowed per character, the segments' length and stride, and the length under which a passage must stand in a text exactly."""

    q: int = 10
    rate: float = 0.06
    segment: int = 80
    stride: int = 40
    least: int = 40

    def edits(self, n: int) -> int:
        """The budget of a segment, lowered where the lemma would otherwise ask for no shared q-gram."""
        return max(0, min(int(self.rate * n), (n - self.q) // self.q))

    def shared(self, n: int) -> int:
        return n - self.q + 1 - self.edits(n) * self.q


def folded(text: str) -> np.ndarray:
    """Code points, lower-cased one by one so that offsets stay."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(c < 65536, LOWER[np.minimum(c, 65535)], c)


def eight_bits(text: str) -> bytes:
    """A byte for each character, the same for equal lower-cased ones: what the filter compares. Only the alignment tells all characters apart."""
    try:
        return text.encode("latin-1").translate(LOWER_BYTES)
    except UnicodeEncodeError:
        points = folded(text)
        return ((points ^ (points >> 8)) & 255).astype(np.uint8).tobytes()


def quads(data: bytes) -> np.ndarray:
    """The four bytes at each place, as a number."""
    n = max(0, len(data) - 3)
    out = np.empty(n, dtype="<u4")
    for i in range(min(4, n)):
        out[i::4] = np.frombuffer(data, "<u4", count=(n - i + 3) // 4, offset=i)
    return out


def slots(w: np.ndarray, q: int) -> np.ndarray:
    """A slot for the q-gram at each place, from its first eight bytes."""
    n = max(0, len(w) + 4 - q)
    return ((w[:n] * ODD_32[0] + w[4 : n + 4] * ODD_32[1]) >> np.uint32(32 - SLOT_BITS)).astype(np.int32)


def grams(w: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-grams (8 <= q <= 12) at some places."""
    return ((w[at].astype(np.uint64) << np.uint64(32)) | w[at + 4]) * ODD[0] + w[at + q - 4] * ODD[1]


class Index:
    """Segments of the passages, equal ones once, and for each q-gram its places in them; short passages in an automaton."""

    def __init__(self, items: list[tuple[object, str]], rules: Rules):
        self.rules = rules
        self.items = [i for i, _ in items]
        self.cut = np.zeros(len(items), dtype=np.int64)  # segments of each item
        found: dict[bytes, list[tuple[int, int]]] = {}
        short: dict[str, list[int]] = {}
        for number, (_, text) in enumerate(items):
            points = folded(text.strip())
            n = len(points)
            if 0 < n < rules.least:
                short.setdefault(points.tobytes().decode("utf-32-le"), []).append(number)
                self.cut[number] = 1
            elif n:
                starts = [*range(0, max(1, n - rules.segment), rules.stride), *[n - rules.segment] * (n > rules.segment)]
                self.cut[number] = len(starts)
                for at in starts:
                    found.setdefault(points[at : at + rules.segment].tobytes(), []).append((number, at))
        self.segments = [np.frombuffer(c, np.uint32) for c in found]
        self.of = list(found.values())  # (item number, offset in the passage) of each segment
        self.short = ahocorasick.Automaton()
        for text, numbers in short.items():
            self.short.add_word(text, (len(text), tuple(numbers)))
        if short:
            self.short.make_automaton()
        self.bytes = [eight_bits(s.tobytes().decode("utf-32-le")) for s in self.segments]
        byte = [quads(b) for b in self.bytes]
        self.size = np.array([len(s) for s in self.segments], dtype=np.int64)
        self.budget = np.array([rules.edits(int(n)) for n in self.size], dtype=np.int64)
        self.needs = np.array([rules.shared(int(n)) for n in self.size], dtype=np.int64)
        h = [grams(w, np.arange(max(0, len(w) + 4 - rules.q)), rules.q) for w in byte]
        hashes = np.concatenate(h) if h else np.zeros(0, dtype=np.uint64)
        segment = np.repeat(np.arange(len(h)), [len(x) for x in h])
        place = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, dtype=np.int64)
        order = np.lexsort((place, segment, hashes))
        hashes, segment, place = hashes[order], segment[order], place[order]
        # places of a q-gram in a segment that are within a band's step of each other are one run: its diagonals meet neighbouring bands
        step = self.budget[segment] + 1
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (segment[1:] != segment[:-1]) | (place[1:] - place[:-1] > step[1:]))) if len(hashes) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(hashes)])) - 1 if len(first) else first
        self.hash, self.segment, self.first, self.last = hashes[first], segment[first], place[first], place[last]
        self.slots = np.zeros(1 << SLOT_BITS, dtype=bool)
        for w in byte:
            self.slots[slots(w, rules.q)] = True

    def regions(self, text: str, piece: int = 1 << 17, most: int = 1 << 20) -> list[tuple[int, int, int]]:
        """(segment, first diagonal, last diagonal) of the bands that share enough q-grams; a diagonal is the place in the text less that in the segment.

        Band b holds the diagonals from b * step to (b + 2) * step, so any step neighbours lie in one band. Each place of the
        text counts once for each band that a run of its q-gram's places meets; only the first and last of these
        bands are noted, about `most` of them at a time, so the memory follows the text, however often it repeats itself.
        """
        w, q = quads(eight_bits(text)), self.rules.q
        at = np.concatenate([np.flatnonzero(self.slots.take(slots(w[i : i + piece + q - 4], q))) + i for i in range(0, max(1, len(w)), piece)])
        if not len(at) or not len(self.hash):
            return []
        h = grams(w, at, q)
        low = np.searchsorted(self.hash, h, "left")
        times = np.searchsorted(self.hash, h, "right") - low
        hit = np.flatnonzero(times)
        if not len(hit):
            return []
        at, low, times = at[hit], low[hit], times[hit]
        wide = len(text) + 4 * self.rules.segment
        shift = 2 * self.rules.segment
        keys, change = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        ends = np.cumsum(times)
        begin = 0
        while begin < len(at):
            to = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
            t = times[begin:to]
            which = np.repeat(low[begin:to] - np.concatenate(([0], np.cumsum(t)[:-1])), t) + np.arange(t.sum())
            segment, place = self.segment[which], np.repeat(at[begin:to], t)
            step = self.budget[segment] + 1
            opened = segment * wide + (place - self.last[which]) // step - 1 + shift
            closed = segment * wide + (place - self.first[which]) // step + 1 + shift
            keys, inverse = np.unique(np.concatenate([keys, opened, closed]), return_inverse=True)
            change = np.bincount(inverse, np.concatenate([change, np.ones(len(opened)), -np.ones(len(closed))]), len(keys)).astype(np.int64)
            begin = to
        count = np.cumsum(change)
        segment = keys // wide
        enough = np.flatnonzero(count >= self.needs[np.minimum(segment, len(self.needs) - 1)])
        out: list[tuple[int, int, int]] = []
        for i in enough.tolist():  # bands from one key to the next; neighbouring ones make one region
            s, step = int(segment[i]), int(self.budget[segment[i]]) + 1
            first, last = int(keys[i]) % wide - shift, int(keys[i + 1]) % wide - shift
            low_, high = first * step, (last + 1) * step - 1
            if out and out[-1][0] == s and out[-1][2] >= low_ - 1:
                out[-1] = (s, out[-1][1], high)
            else:
                out.append((s, low_, high))
        return out

    def exact(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """Matches of the short passages, as matches() has them: whole words, whatever their case."""
        if not len(self.short):
            return []
        t = folded(text).tobytes().decode("utf-32-le")
        out = []
        for end, (n, numbers) in self.short.iter(t):
            start, end = end + 1 - n, end + 1
            if not (start and t[start - 1].isalnum() and t[start].isalnum()) and not (end < len(t) and t[end - 1].isalnum() and t[end].isalnum()):
                out += [(number, 0, start, end, 0) for number in numbers]
        return out


def align(segment: np.ndarray, points: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole segment on diagonals low to high of points."""
    width = high - low + 1
    column = np.arange(width, dtype=np.int32)
    padded = np.zeros(len(segment) + width, dtype=np.int32)
    a, b = max(0, low), min(len(points), low + len(padded))
    if a < b:
        padded[a - low : b - low] = points[a:b] + 1
    cost = np.zeros(width, dtype=np.int32)
    for i, x in enumerate(segment.astype(np.int32) + 1):
        now = cost + (padded[i : i + width] != x)
        now[:-1] = np.minimum(now[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(now - column) + column
    best = int(cost.argmin())
    return int(cost[best]), low + len(segment) + best


def matches(text: str, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(item number, offset in the passage, start, end, edits) of the verified segments, the best one of each segment and place."""
    points, data = folded(text), eight_bits(text)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s, low, high in index.regions(text):
        segment = index.segments[s]
        exact = data.find(index.bytes[s], max(0, low), max(0, high + len(segment)))
        if exact >= 0 and np.array_equal(points[exact : exact + len(segment)], segment):
            best[s, exact + len(segment)] = (exact, exact + len(segment), 0)
            continue
        edits, end = align(segment, points, low, high)
        if edits <= index.budget[s]:
            last = min(end, len(points))
            first = max(0, last - len(segment) - edits)
            cut = points[first:last][::-1]
            _, back = align(segment[::-1], cut, 0, max(0, min(2 * edits, len(cut))))
            if (s, end) not in best or best[s, end][2] > edits:
                best[s, end] = (max(0, last - back), last, edits)
    return sorted([(number, at, *found) for (s, _), found in best.items() for number, at in index.of[s]] + index.exact(text))


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[tuple[list[tuple[object, str]], pa.DataType]]:
    """The passages in blocks of about block_chars characters, which bounds what is sent to a task, however large the benchmark; and the ids' type."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars)
    for b in range(n):
        t = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").toArrow()
        yield list(zip(t.column("i").to_pylist(), t.column("t").to_pylist())), t.schema.field("i").type


def hit_texts(values: list[str | None], index: Index, together: int = 1 << 17) -> Iterator[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """(row, matches) of the texts that have some. Short texts are filtered together, long ones alone, and all to their end."""
    at = 0
    while at < len(values):
        to, size = at, 0
        while to < len(values) and (to == at or size + len(values[to] or "") <= together):
            size += len(values[to] or "")
            to += 1
        each = [x or "" for x in values[at:to]]
        starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in each])))
        rows = {r for r, x in enumerate(each) if len(index.short) and index.exact(x)}
        for s, low, high in index.regions("\0".join(each)):  # every row that the region reaches
            first, last = np.searchsorted(starts, (max(0, low), max(0, high) + int(index.size[s])), "right") - 1
            rows.update(range(int(first), min(int(last), len(each) - 1) + 1))
        for r in sorted(rows):
            if found := matches(each[r], index):
                yield at + r, found
        at = to


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: Rules = Rules(), block_chars: int = 4_000_000) -> DataFrame:
    """(id, item_id, n_segments, segments_found, start, end, edits): one row for each text row and passage in it.

    start and end span the passage's segments in the text (code points, end exclusive), edits is the sum over its
    segments. Segments overlap by half, so any excerpt of 1.5 segments holds a whole one. Passages under `least`
    characters must stand in the text exactly, at word borders and in any case. Blank and NULL passages never match;
    NULL and empty texts have no matches. Repeated rows on either side match on their own. One pass without a shuffle
    for each block of the benchmark; a block's index goes to the tasks and is bounded by block_chars and its longest passage.
    """
    d, i = docs.schema[doc_id], benchmark.schema[item_id]
    out_i = item_id if item_id != doc_id else f"benchmark_{item_id}"
    ddl = f"`{doc_id}` {d.dataType.simpleString()}, `{out_i}` {i.dataType.simpleString()}, n_segments bigint, segments_found bigint, start bigint, end bigint, edits bigint"
    source = docs.select(doc_id, F.col(text).cast("string").alias("_text_"))
    parts = []
    for items, kind in blocks(benchmark, item_id, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, rules))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, kind=kind) -> Iterator[pa.RecordBatch]:
            index = shared.value
            names = [doc_id, out_i, "n_segments", "segments_found", "start", "end", "edits"]
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    rows: list[tuple] = []
                    for r, found in hit_texts(part.column(1).to_pylist(), index):
                        for number in sorted({m[0] for m in found}):
                            of = [m for m in found if m[0] == number]
                            best = {m[1]: m for m in sorted(of, key=lambda m: -m[4])}
                            rows.append((r, index.items[number], int(index.cut[number]), len(best), min(m[2] for m in best.values()), max(m[3] for m in best.values()), sum(m[4] for m in best.values())))
                    if rows:
                        row, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(x, t) for x, t in zip(rest, [kind, *[pa.int64()] * 5]))], names=names)

        parts.append(source.mapInArrow(run, ddl))
    if not parts:
        return docs.sparkSession.createDataFrame([], ddl)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: Rules = Rules(), block_chars: int = 4_000_000) -> DataFrame:
    """The rows of `docs` whose text holds no passage of the benchmark (see find), with all their columns, in one pass a block. NULL and empty texts hold none; repeated rows are judged alike; an empty benchmark keeps all."""
    for items, _ in blocks(benchmark, item_id, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, rules))
        place = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    bad = {r for r, _ in hit_texts(part.column(place).to_pylist(), shared.value)}
                    yield part.filter(pa.array([r not in bad for r in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
