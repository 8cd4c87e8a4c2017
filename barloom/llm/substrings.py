"""Substring dedup: repeated windows of words, found with an FM-index per shard.

A window's least shingle hash is its key, so equal windows have equal keys, and consecutive windows of one key are a
run of text. Runs whose key two documents have are dealt out by key into shards of bounded size. Each shard builds a
compressed FM-index (a wavelet matrix of packed bits over the Burrows-Wheeler transform of its different runs) and
streams the runs through it by backward search: the interval of each window gives the least document that holds it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, texts

SEED = 42
#: Two odd 64-bit multipliers, for the polynomial of a shingle and for mixing its bits.
STEP, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

RUN = pa.struct([("key", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
RUN_DDL = "struct<key: bigint, seg: bigint, start: int, n: int>"


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Line:
    """A text's words joined by single spaces, and where each of them stands."""

    def __init__(self, text: str | None):
        self.words = text.encode().split() if text else []
        self.line = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))

    def pieces(self, starts: np.ndarray, n_words: np.ndarray) -> list[bytes]:
        return [self.line[a:b] for a, b in zip(self.starts[starts].tolist(), self.ends[starts + n_words - 1].tolist())]


def runs_of(line: Line, known: WordHashes, window: int, shingle: int) -> tuple[np.ndarray, ...]:
    """(key, start, n) of the runs of n consecutive windows that have one least shingle hash."""
    n = len(line.words)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, line.words), np.uint64, n)
    g = np.zeros(n - shingle + 1, dtype=np.uint64)
    for j in range(shingle):
        g += h[j : n - shingle + 1 + j] * np.uint64(pow(STEP, j, 1 << 64))
    g = (g ^ (g >> np.uint64(31))) * np.uint64(MIX)
    least = sliding_least(g ^ (g >> np.uint64(29)), window - shingle + 1)
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[cut], cut, np.diff(np.append(cut, len(least)))


def hashed(pieces: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)).view(np.int64)


def run_lists(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x[0]) for x in found)], dtype=np.int32)
    kinds = (np.int64, np.int64, np.int32, np.int32)
    columns = [np.concatenate([np.zeros(0, kind), *(x[i].astype(kind) for x in found)]) for i, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(RUN)))


def surveyed(docs: DataFrame, window: int, shingle: int) -> DataFrame:
    """(id, h, n_words, kept_sha256 of all words, runs) for each row of (id, h, body): one pass."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, n_words, shas, found = b.slice(at, 512), [], [], []
                for text in texts(part, 2):
                    line = Line(text)
                    key, start, n = runs_of(line, known, window, shingle)
                    n_words.append(len(line.words))
                    shas.append(hashlib.sha256(line.line).hexdigest())
                    found.append((key.view(np.int64), hashed(line.pieces(start, n + window - 1)), start, n))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), run_lists(found)], names=["id", "h", "n_words", "kept_sha256", "runs"])

    return docs.mapInArrow(make, f"id bigint, h bigint, n_words bigint, kept_sha256 string, runs array<{RUN_DDL}>")


def single_windows(rows: DataFrame, window: int) -> DataFrame:
    """(id, h, key, seg, start, n = 1) of every window of the runs (start, n) listed in `wanted`, under hashes of its own words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(texts(b, 2, 16)):
                line = Line(text)
                starts = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in b.column(3)[i].as_py()]))
                for at in range(0, len(starts), 1 << 14):
                    some = starts[at : at + (1 << 14)]
                    pieces = line.pieces(some, np.full(len(some), window))
                    keys = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), np.uint64, len(pieces)).view(np.int64)
                    same = [pa.array([b.column(c)[i].as_py()] * len(some), pa.int64()) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(keys), pa.array(hashed(pieces)), pa.array(some.astype(np.int32)), pa.array(np.ones(len(some), np.int32))], names=["id", "h", "key", "seg", "start", "n"])

    return rows.select("id", "h", "body", "wanted").mapInArrow(make, "id bigint, h bigint, key bigint, seg bigint, start int, n int")


def cut_out(rows: DataFrame, window: int) -> DataFrame:
    """(key, seg, first_id, last_id, words) of the runs listed in `wanted`."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, bodies = b.slice(at, 64), []
                lists = part.column(1)
                wanted = lists.flatten()
                start, n = (wanted.field(c).to_numpy() for c in ("start", "n"))
                ends = np.cumsum(lists.value_lengths().to_numpy())
                for text, lo, hi in zip(texts(part, 0, 16), [0, *ends[:-1].tolist()], ends.tolist()):
                    bodies += Line(text).pieces(start[lo:hi], n[lo:hi] + window - 1)
                yield pa.RecordBatch.from_arrays([*(wanted.field(c) for c in ("key", "seg", "first_id", "last_id")), pa.array(bodies, pa.binary())], names=["key", "seg", "first_id", "last_id", "words"])

    return rows.select("body", "wanted").mapInArrow(make, "key bigint, seg bigint, first_id bigint, last_id bigint, words binary")


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by more than `depth` symbols, and numbers that are equal where `depth` symbols are: prefix doubling."""

    def after(rank: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([rank[k:], np.zeros(min(k, len(rank)), dtype=np.int64)])

    def paired(rank: np.ndarray, k: int) -> np.ndarray:
        return rank * (int(rank.max()) + 1) + after(rank, k)

    rank, have = symbols.astype(np.int64), 1
    while 2 * have <= depth:
        rank = np.unique(paired(rank, have), return_inverse=True)[1]
        have *= 2
    same = paired(rank, depth - have)
    return np.argsort(paired(rank, have), kind="stable"), same


class FMIndex:
    """Backward search over a text of small integers: its transform as a wavelet matrix, 64 bits a word with a count before each."""

    def __init__(self, symbols: np.ndarray, order: np.ndarray):
        sigma = int(symbols.max()) + 1
        row = symbols[order - 1]
        self.levels = []
        for level in reversed(range(max(1, (sigma - 1).bit_length()))):
            bit = ((row >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, dtype=bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32)
            self.levels.append((level, words, before, len(bit) - int(bit.sum())))
            row = np.concatenate([row[~bit], row[bit]])
        known = np.arange(sigma)
        counts = np.bincount(symbols, minlength=sigma)
        self.shift = np.concatenate(([0], np.cumsum(counts)[:-1])) - self.walk(np.zeros(sigma, dtype=np.int64), known)

    def walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol + pattern, from those of the patterns."""
        both = self.walk(np.concatenate([lo, hi]), np.concatenate([symbol, symbol])) + np.tile(self.shift[symbol], 2)
        return both[: len(lo)], both[len(lo) :]


class Numbers(dict):
    """Consecutive numbers for words, from one; zero ends a run."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def least_holders(bodies: list[list[bytes]], ids: np.ndarray, window: int, piece: int = 64) -> list[np.ndarray]:
    """For each run and each of its windows: the least of `ids` over all runs that hold the window."""
    number = Numbers()
    symbols = np.fromiter((number[w] if w is not None else 0 for body in bodies for w in (*body, None)), np.int64)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order, same = suffix_order(symbols, window)
    index = FMIndex(symbols, order)
    # intervals of patterns of `window` words: what a longer pattern's interval falls back to
    starts = np.flatnonzero(np.concatenate(([True], same[order][1:] != same[order][:-1])))
    block = np.zeros(len(order), dtype=np.int64)
    block[starts[1:]] = 1
    block = np.cumsum(block)
    ends = np.append(starts[1:], len(order))
    least = np.minimum.reduceat(np.repeat(ids, sizes + 1)[order], starts)
    # runs are streamed in pieces of so many windows, all in step, the longest first
    windows = sizes - window + 1
    per_run = -(-windows // piece)
    run = np.repeat(np.arange(len(bodies)), per_run)
    first = (np.arange(len(run)) - np.repeat(np.cumsum(per_run) - per_run, per_run)) * piece
    n = np.minimum(windows[run] - first, piece)
    longest = np.argsort(-n, kind="stable")
    low, n = (begins[run] + first)[longest], n[longest]
    at = low + n - 1 + window - 1
    lo, hi = np.zeros(len(n), dtype=np.int64), np.full(len(n), len(order))
    found = np.zeros(len(symbols), dtype=np.int64)
    for step in range(int(n[0]) + window - 1):
        active = int(np.searchsorted(-n, -(step - window + 1), "left")) if step >= window else len(n)
        lo, hi, at = lo[:active], hi[:active], at[:active]
        lo, hi = index.extend(lo, hi, symbols[at])
        if step >= window - 1:
            b = block[lo]
            found[at] = least[b]
            lo, hi = starts[b], ends[b]
        at = at - 1
    return [found[a : a + m] for a, m in zip(begins.tolist(), windows.tolist())]


def search_shard(t: pa.Table, window: int) -> pa.Table:
    """(key, seg, off, n, least): stretches of n windows, from number off, whose least holder is under the run's last one."""
    first, last = (np.asarray(t.column(c)) for c in ("first_id", "last_id"))
    found = least_holders([w.split(b" ") for w in t.column("words").to_pylist()], first, window)
    of, off, n, least = [], [], [], []
    for i, holder in enumerate(found):
        cut = np.flatnonzero(np.concatenate(([True], holder[1:] != holder[:-1])))
        size = np.diff(np.append(cut, len(holder)))
        some = holder[cut] < last[i]
        of.append(np.full(int(some.sum()), i))
        off.append(cut[some])
        n.append(size[some])
        least.append(holder[cut][some])
    of_, off_, n_, least_ = (np.concatenate(x) for x in (of, off, n, least))
    key, seg = (np.asarray(t.column(c))[of_] for c in ("key", "seg"))
    return pa.table({"key": key, "seg": seg, "off": off_.astype(np.int32), "n": n_.astype(np.int32), "least": least_})


def without(rows: DataFrame, window: int) -> DataFrame:
    """(id, h, n_removed, kept_sha256, kept): texts without the words that the windows in `cuts` (start, n) cover."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, removed, kept = b.slice(at, 64), [], []
                lists = part.column(3)
                start, n = (lists.flatten().field(c).to_numpy() for c in ("start", "n"))
                ends = np.cumsum(lists.value_lengths().to_numpy())
                for text, lo, hi in zip(texts(part, 2, 16), [0, *ends[:-1].tolist()], ends.tolist()):
                    words = text.encode().split()
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(change, start[lo:hi], 1)
                    np.add.at(change, start[lo:hi] + n[lo:hi] + window - 1, -1)
                    stays = np.cumsum(change)[:-1] == 0
                    removed.append(len(words) - int(stays.sum()))
                    kept.append(b" ".join([w for w, s in zip(words, stays.tolist()) if s]))
                shas = [hashlib.sha256(k).hexdigest() for k in kept]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(shas), pa.array([k.decode() for k in kept])], names=["id", "h", "n_removed", "cut_sha256", "kept"])

    return rows.select("id", "h", "body", "cuts").mapInArrow(make, "id bigint, h bigint, n_removed bigint, cut_sha256 string, kept string")


def repeated_windows(docs: DataFrame, scratch: Scratch, found: DataFrame, window: int = 50, shard_words: int = 400_000, key_words: int = 1_000_000) -> DataFrame:
    """(id, h, cuts): for rows of (id, h, body), the windows (start, n) that a document with a smaller id holds too."""
    spread = found.where("id IS NOT NULL").select("id", "h", F.inline("runs"))

    def shared(each: DataFrame) -> DataFrame:
        """Rows whose key two documents have."""
        keys = scratch.put(each.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key"))
        out = scratch.put(each.join(keys, "key"))
        scratch.drop(keys)
        return out

    def distinct(each: DataFrame) -> DataFrame:
        least = F.min(F.struct("id", "h", "start")).alias("first")
        return each.groupBy("key", "seg").agg(least, F.max("id").alias("last_id"), F.first("n").alias("n"))

    have = shared(spread)
    segs = scratch.put(distinct(have))
    crowded = segs.groupBy("key").agg(F.sum(F.col("n") + window - 1).alias("size")).where(F.col("size") > key_words).select("key")
    if not crowded.isEmpty():
        # too many different runs for one shard: their windows under keys of their own, of which one alone can't be shared
        crowded = scratch.put(crowded)
        of_rows = have.join(crowded, "key").groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("wanted"))
        single = scratch.put(single_windows(docs.join(of_rows, ["id", "h"]), window))
        alone = shared(single)
        was, have = have, scratch.put(have.join(crowded, "key", "left_anti").unionByName(alone))
        scratch.drop(was, segs, single, alone, crowded)
        segs = scratch.put(distinct(have))

    words = segs.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(1, math.ceil(words / shard_words))
    run = F.struct("key", "seg", F.col("first.id").alias("first_id"), "last_id", F.col("first.start").alias("start"), "n")
    wanted = segs.groupBy(F.col("first.id").alias("id"), F.col("first.h").alias("h")).agg(F.collect_list(run).alias("wanted"))
    bodies = cut_out(docs.join(wanted, ["id", "h"]), window).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    seen = scratch.put(bodies.groupBy("shard").applyInArrow(lambda t: search_shard(t, window), "key bigint, seg bigint, off int, n int, least bigint"))
    cuts = seen.join(have.select("key", "seg", "id", "h", "start"), ["key", "seg"]).where("least < id").select("id", "h", (F.col("start") + F.col("off")).alias("start"), "n")
    out = scratch.put(cuts.groupBy("id", "h").agg(F.collect_set(F.struct("start", "n")).alias("cuts")))
    scratch.drop(seen, have, segs)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, shingle: int = 8, shard_words: int = 400_000, key_words: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row; `kept` is NULL where the whole text stays.

    Removed is each word that a window of `window` consecutive words covers whose words also stand in a document with
    a smaller id; windows are judged on the input. Only runs of windows whose key two documents have travel, each
    different one once. A shard has about `shard_words` words; a key that has over `key_words` words of different runs
    (a passage that many texts surround) is split into single windows, which then travel only if two documents have
    them. So neither a shard nor a key grows with the input. Texts under a window lose nothing. NULL, empty and
    wordless texts have no words. Repeated rows and rows of one id don't remove each other's words; a row without an
    id neither loses words nor makes others lose them. A long text is read whole by one task. Ids are read as longs;
    other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    if not 1 <= shingle < window:
        raise ValueError("a shingle has at least one word and fewer than the window")
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("body"))
    found = scratch.put(surveyed(source, window, shingle))
    cuts = repeated_windows(source, scratch, found, window, shard_words, key_words)
    removed = without(source.join(cuts, ["id", "h"]).dropDuplicates(["id", "h"]), window)
    rest = found.select("id", "h", "n_words", "kept_sha256").join(removed, ["id", "h"], "left")
    return rest.select(F.col("id").alias(doc_id), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"), "kept")
