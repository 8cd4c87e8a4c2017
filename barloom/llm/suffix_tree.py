"""Language-model scores from a probabilistic suffix tree over words.

A context, up to `depth` preceding words, is a state of the tree if the corpus has it often enough and its next-word
distribution diverges from that of its suffix. Distributions are smoothed towards the suffix's, down to the word
unigrams of the base score. A text is scored with the longest suffix that is a state, at each word and at its end.

The tree has a state for each such context of the corpus, so it grows with the input and is never in one place. Texts
form blocks of about `block_tokens` words. A block asks for the counts of its word sequences: sorted hashes, packed,
go to the task of their range of hash values, which adds up all blocks' counts and answers each in the order asked.
A second such exchange adds up the divergence of each context. So nothing is sent more than once a block, however
frequent it is, and a block's and a range's work have a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts

#: Hashes of the start and the end of a text, which no word's collides with but by chance.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Odd multipliers that mix hashes.
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Settings:
    depth: int = 2  # words of the longest contexts
    least: int = 2  # occurrences of a context, to be considered
    divergence: float = 4.0  # nats of its occurrences in all from the suffix's distribution, for a context to be retained
    prior: float = 10.0  # words' worth of weight of the suffix's distribution
    block_tokens: int = 1_500_000
    range_tokens: int = 4_000_000  # hashes that a task adds up
    spare_bits: int = 14  # a sequence's hash has so many bits more than the corpus' number of words has: about one in 2^14 collides


class Numbers(dict):
    """Words by the order of their first appearance, from 1; 0 is the end of a text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers, compressed byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def packed_set(ascending: np.ndarray) -> bytes:
    return packed(np.diff(ascending, prepend=np.uint64(0)))


def unpacked_set(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([END, *(xxhash.xxh64_intdigest(w) for w in words)], dtype=np.uint64)


BLOCK = "block bigint, learn binary, lengths binary, tokens binary, words binary, n_tokens bigint, n_learn bigint, n_texts bigint"


def blocks(rows: DataFrame, s: Settings) -> DataFrame:
    """(block, ids, ...): texts of `rows` (_id_, _text_, _learn_) as numbers of a block's own words, with the words' hashes. One pass, no shuffle."""
    kept = rows.schema["_id_"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        ids, learn, lengths, parts, numbers, size = [], [], [], [], Numbers(), 0
        kind = None

        def row() -> pa.RecordBatch:
            tokens, n, may = np.concatenate(parts), np.array(lengths), np.array(learn, dtype=bool)
            frequent = np.argsort(-np.bincount(tokens, minlength=len(numbers) + 1), kind="stable")  # small numbers for frequent words pack better
            number = np.empty(len(frequent), dtype=np.int64)
            number[frequent] = np.arange(len(frequent))
            values = [serial, packed(may), packed(n), packed(number[tokens]), packed(word_hashes(list(numbers))[frequent]), int(n.sum()), int(n[may].sum()), int(may.sum())]
            names = ["ids", *(x.split()[0] for x in BLOCK.split(", "))]
            types = [pa.binary() if x.endswith("binary") else pa.int64() for x in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(ids)], pa.array(ids, kind)), *(pa.array([v], t) for v, t in zip(values, types))], names=names)

        for batch in batches:
            kind = batch.schema.types[0]
            for i, may, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts(batch, 1)):
                w = text.encode().lower().split() if text else []
                parts.append(np.fromiter(map(numbers.__getitem__, w), np.uint32, len(w)))
                parts.append(np.zeros(1, dtype=np.uint32))
                ids.append(i)
                learn.append(may)
                lengths.append(len(w) + 1)
                size += len(w) + 1
                if size >= s.block_tokens:
                    yield row()
                    serial += 1
                    ids, learn, lengths, parts, numbers, size = [], [], [], [], Numbers(), 0
        if ids:
            yield row()

    return rows.select("_id_", "_text_", "_learn_").mapInArrow(run, f"ids array<{kept}>, {BLOCK}")


class Block:
    """A block's texts: at each place the hash of the word and of the sequences that end there, by level (words before it)."""

    def __init__(self, row: dict, depth: int, bits: int):
        self.lengths = unpacked(row["lengths"]).astype(np.int64)
        self.learn = np.repeat(unpacked(row["learn"]).astype(bool), self.lengths)
        self.start = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        word = unpacked(row["words"])[unpacked(row["tokens"]).astype(np.int64)]
        level, keys, before = word, [word], word
        for d in range(1, depth + 1):
            before = np.concatenate(([START], before[:-1]))
            first = self.start if d == 1 else (self.start[:, None] + np.arange(d))[np.arange(d) < self.lengths[:, None]]
            before[first] = START  # places with fewer than d words before them
            level = mixed(level * ODD[0] + before)
            keys.append(level >> np.uint64(64 - bits))
        self.keys = keys
        self.unique = [np.unique(k, return_inverse=True) for k in keys]

    def counted(self, d: int) -> np.ndarray:
        """How often the learned texts of the block have each of its sequences of level d."""
        return np.bincount(self.unique[d][1][self.learn], minlength=len(self.unique[d][0]))

    def after(self, of_place: np.ndarray, at_start: float) -> np.ndarray:
        """Values of the place before each; at_start at the first of a text."""
        out = np.concatenate(([0], of_place[:-1]))
        out[self.start] = at_start
        return out


def ranges(keys: np.ndarray, bits: int, range_bits: int) -> Iterator[tuple[int, slice]]:
    """(range, part) of ascending hashes by their highest bits."""
    which = (keys >> np.uint64(bits - range_bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(which)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
        if a < b:
            yield int(which[a]), slice(a, b)


ASK = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("range", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
ASKED = "block bigint, level int, `range` bigint, keys binary, `values` binary"
ANSWER = "block bigint, level int, `range` bigint, answer binary, own binary, distinct bigint"


def merged(t: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What blocks ask about one range: the rows, their cuts, and the order, first places and sizes of equal hashes."""
    rows = sorted(t.to_pylist(), key=lambda r: r["block"])
    keys = [unpacked_set(r["keys"]) for r in rows]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(every[order]) != 0)))
    return rows, np.cumsum([0, *map(len, keys)]), order, first, np.diff(first, append=len(every))


def add_up(t: pa.Table) -> pa.Table:
    """Each block's hashes answered with all blocks' counts; one block owns each sequence that was learned."""
    rows, cut, order, first, size = merged(t)
    counts = np.concatenate([unpacked(r["values"]) for r in rows])
    total = np.add.reduceat(counts[order], first)
    answer, own = np.zeros(len(order), dtype=np.uint64), np.zeros(len(order), dtype=bool)
    answer[order] = np.repeat(total, size)
    own[order[first]] = total > 0
    out = [{"block": r["block"], "level": r["level"], "range": r["range"], "answer": packed(answer[a:b]), "own": np.packbits(own[a:b]).tobytes(), "distinct": int(own[a:b].sum())} for r, a, b in zip(rows, cut, cut[1:])]
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("level", pa.int32()), ("range", pa.int64()), ("answer", pa.binary()), ("own", pa.binary()), ("distinct", pa.int64())]))


def answers(t: pa.Table, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By level, what a block was answered in the order of its hashes, and which sequences it owns."""
    found, own = [[] for _ in range(levels)], [[] for _ in range(levels)]
    for r in sorted(t.to_pylist(), key=lambda r: (r["level"], r["range"])):
        found[r["level"]].append(unpacked(r["answer"]))
        own[r["level"]].append(np.unpackbits(np.frombuffer(r["own"], np.uint8), count=len(found[r["level"]][-1])).astype(bool))
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in found], [np.concatenate(x) if x else np.zeros(0, dtype=bool) for x in own]


def score(docs: DataFrame, may_learn: Column, doc_id: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row; the model learns from rows where may_learn holds.

    Tokens are a text's words and one end. Contexts begin anew with each text. Words are told apart by 64-bit
    hashes, longer sequences by hashes with spare_bits more bits than the corpus has words. NULL and empty texts are
    the end alone; repeated and NULL ids keep a row each (NULL ids aren't learned from by the usual fold). With nothing
    to learn, N and V are 0 and the score is the base score. An empty table gives an empty result. A block holds at
    least one text whole, so a task's memory follows block_tokens or the longest text.
    """
    spark, kept = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    scratch = Scratch(spark)
    rows = docs.select(F.col(doc_id).alias("_id_"), F.col(text).cast("string").alias("_text_"), F.coalesce(may_learn, F.lit(False)).alias("_learn_"))
    made = scratch.put(blocks(rows, s))
    sums = made.agg(F.sum("n_tokens"), F.sum("n_learn"), F.sum("n_texts")).first()
    total, n, n_texts = (x or 0 for x in sums)
    bits = min(62, math.ceil(math.log2(total + 2)) + s.spare_bits)
    range_bits = max(5, math.ceil(math.log2(max(1, total / s.range_tokens))))
    widths = [64, *[bits] * s.depth]
    held = made.drop("n_tokens", "n_learn", "n_texts").groupBy("block")  # the same for both cogroups, so that it is shuffled once

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r, s.depth, bits)
                for d, (keys, _) in enumerate(b.unique):
                    counts = b.counted(d)
                    out = [{"block": r["block"], "level": d, "range": i, "keys": packed_set(keys[part]), "values": packed(counts[part])} for i, part in ranges(keys, widths[d], range_bits)]
                    yield pa.RecordBatch.from_pylist(out, ASK)

    counted = scratch.put(made.drop("ids", "n_tokens", "n_learn", "n_texts").mapInArrow(ask, ASKED).groupBy("level", "range").applyInArrow(add_up, ANSWER))
    v = counted.where("level = 0").agg(F.sum("distinct")).first()[0] or 0

    def places(b: Block, found: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By level, the count of the sequence at each place, and of its context."""
        count = [found[d][b.unique[d][1]].astype(np.float64) for d in range(s.depth + 1)]
        return count, [np.full(len(count[0]), float(n)), *(b.after(count[d - 1], n_texts) for d in range(1, s.depth + 1))]

    def diverge(left: pa.Table, right: pa.Table) -> pa.Table:
        """For each context of a block: how far the sequences that the block owns take it from its suffix, in nats times 2^10."""
        if not left.num_rows:
            return ASK.empty_table()
        r = left.drop_columns("ids").to_pylist()[0]
        b = Block(r, s.depth, bits)
        found, own = answers(right, s.depth + 1)
        count, context = places(b, found)
        inner = np.ones(len(b.learn), dtype=bool)
        inner[b.start] = False
        out = []
        for d in range(1, s.depth + 1):
            keys, inverse = b.unique[d - 1]
            before = np.concatenate(([0], inverse[:-1]))  # the context's number
            likely = inner & (context[d] >= s.least)
            part = np.zeros(len(keys))
            first = np.full(len(b.unique[d][0]), -1)
            first[b.unique[d][1][likely][::-1]] = np.flatnonzero(likely)[::-1]
            at = first[own[d] & (first >= 0)]  # one place of each sequence owned
            c, of, shorter, of_shorter = count[d][at], context[d][at], count[d - 1][at], context[d - 1][at]
            np.add.at(part, before[at], c * np.log(c / of * of_shorter / shorter))
            asked = np.zeros(len(keys), dtype=bool)
            asked[before[likely]] = True
            which = np.flatnonzero(asked)
            for i, cut in ranges(keys[which], widths[d - 1], range_bits):
                signed = np.rint(part[which[cut]] * 2**10).astype(np.int64)
                out.append({"block": r["block"], "level": d, "range": i, "keys": packed_set(keys[which][cut]), "values": packed(((signed << 1) ^ (signed >> 63)).view(np.uint64))})
        return pa.Table.from_pylist(out, ASK)

    def decide(t: pa.Table) -> pa.Table:
        """Each block's contexts answered with whether they are states."""
        rows, cut, order, first, size = merged(t)
        z = np.concatenate([unpacked(r["values"]) for r in rows])
        parts = (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)
        state = np.zeros(len(order), dtype=bool)
        state[order] = np.repeat(np.add.reduceat(parts[order], first) >= int(s.divergence * 2**10), size)
        out = [{"block": r["block"], "level": r["level"], "range": r["range"], "states": packed(state[a:b])} for r, a, b in zip(rows, cut, cut[1:])]
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("level", pa.int32()), ("range", pa.int64()), ("states", pa.binary())]))

    asked = held.cogroup(counted.groupBy("block")).applyInArrow(diverge, ASKED)
    states = asked.groupBy("level", "range").applyInArrow(decide, "block bigint, level int, `range` bigint, states binary")
    replies = counted.select("block", "level", "range", "answer", "own", F.lit(None).cast("binary").alias("states")).union(states.select("block", "level", "range", F.lit(None).cast("binary"), F.lit(None).cast("binary"), "states"))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.drop_columns("ids").to_pylist()[0]
        b = Block(r, s.depth, bits)
        told = right.column("states").is_valid()
        found, _ = answers(right.filter(right.column("states").is_null()), s.depth + 1)
        count, context = places(b, found)
        p = (count[0] + 0.5) / (n + 0.5 * (v + 1))
        base = np.log10(p)
        decided = sorted(right.filter(told).to_pylist(), key=lambda x: (x["level"], x["range"]))
        for d in range(1, s.depth + 1):
            keys, inverse = b.unique[d - 1]
            asked = np.zeros(len(keys), dtype=bool)
            likely = context[d] >= s.least
            likely[b.start] = False
            asked[np.concatenate(([0], inverse[:-1]))[likely]] = True
            state = np.zeros(len(keys), dtype=bool)
            mine = [unpacked(x["states"]) for x in decided if x["level"] == d]
            state[asked] = np.concatenate(mine).astype(bool) if mine else False
            holds = b.after(state[inverse], d == 1 and n_texts > 0).astype(bool)
            p = np.where(holds, (count[d] + s.prior * p) / (context[d] + s.prior), p)
        by_text = lambda x: np.add.reduceat(x, b.start)
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(b.lengths), pa.array(by_text((count[0] > 0).astype(np.int64))), pa.array(by_text(base)), pa.array(by_text(np.log10(p)))], names=["_id_", "n_tokens", "n_known", "base_score", "score"])

    out = scratch.put(held.cogroup(replies.groupBy("block")).applyInArrow(scored, f"_id_ {kept}, n_tokens bigint, n_known bigint, base_score double, score double"))
    scratch.drop(made, counted)
    return out.select(F.col("_id_").alias(doc_id), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
