"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut into full windows and a remainder. Remainders are gathered within a task until they
fill a bounded group, cut into short pieces and dealt to windows by differencing: partial partitions are merged with
opposing imbalances, which leaves windows of nearly equal fill. If a window would exceed the capacity, the group gets
one window more.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = (("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()))


# Fixed value: the pattern by which byte-level BPE files of this kind split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of white space as the pattern knows it (Unicode's), so long that the pattern's look-ahead would exhaust its stack.
LONG_SPACE = re.compile("[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids for a byte-level BPE file of the tokenizers library, whose own ids these are.

    Such a file numbers its tokens in the order of their merges, so its vocabulary serves as the ranks of tiktoken,
    which is several times faster on one core. A file that isn't of that kind raises ValueError. Strings of special
    tokens in a text give their ids, as in the library's default. Very long runs of white space are merged as a piece
    of their own, which is what the pattern makes of them (all but the last character, if something follows).
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    split = file["pre_tokenizer"] or {}
    vocab, merges = file["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or file["normalizer"] or made != sorted(made):
        raise ValueError(f"{path}: not a byte-level BPE file with the usual split and tokens in the order of their merges")
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    usual = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy
    whole = tiktoken.Encoding(f"{path} whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        for m in LONG_SPACE.finditer(text) if len(text) >= 10_000 else ():
            last = m.end() == len(text) or text.startswith(tuple(special), m.end())
            parts += [usual(text[at : m.start()], allowed_special="all"), whole(text[m.start() : m.end() if last else m.end() - 1])]
            at = m.end() if last else m.end() - 1
        return np.concatenate([*parts, usual(text[at:], allowed_special="all")])

    return encode


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Items dealt to k bins by largest differencing.

    A partial partition is a list of (sum, items) with zeros left out, largest first, and its imbalance is the largest
    sum less the smallest. The two most imbalanced are merged, the largest bins of one with the smallest of the other,
    and what all bins have in common is subtracted.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        if len(a) + len(b) <= k:
            merged = a + b
        else:
            over = len(a) + len(b) - k  # so many bins of a, its smallest, meet the smallest of b in opposite order
            merged = a[: len(a) - over] + b[: len(b) - over]
            merged += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]))]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        if low:
            merged = [(s - low, items) for s, items in merged]
        heapq.heappush(heap, (merged[-1][0] * (len(merged) == k) - merged[0][0], serial, merged))
        serial += 1
    bins = [items for _, items in heap[0][2]]
    return bins + [[] for _ in range(k - len(bins))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of nearly equal fill, none over the capacity; as few as the total allows, and more while one is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        bins = difference(sizes, k)
        if max(sum(sizes[i] for i in b) for b in bins) <= capacity:
            return bins
        k += 1


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 0, piece: int = 128, group_windows: int = 256, carry_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids if carry_ids).

    A document is its token ids, then end_id; a NULL or empty text is the end_id alone. Its full windows are sequences
    of their own. The rest of up to capacity - 1 ids is cut into pieces of at most `piece` and packed with those of the
    documents around it, group_windows windows at a time, so a task holds a few MB. Only the last, partial group
    of a task can leave more than a window's padding. There is no shuffle: sequences are numbered
    by task and place in it, which a repeated task repeats, provided that its input is read in the same order (a table
    is; write other inputs first). Rows with repeated or NULL ids are documents of their own.
    """
    kept = docs.schema[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        serial = 0
        waiting: list[tuple[object, int, np.ndarray, int]] = []
        held = 0

        def rows(found: list[tuple]) -> pa.RecordBatch:
            ids, starts, pieces, totals, seqs, offsets = zip(*found)
            arrays = [pa.array(ids, key), pa.array(starts, pa.int64()), pa.array([len(p) for p in pieces], pa.int64()), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(totals, pa.int64()), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([p.astype(np.int64) for p in pieces], pa.list_(pa.int64()))] * carry_ids, names=names)

        def deal() -> list[tuple]:
            nonlocal waiting, held, serial
            cut = [(d, at + i, ids[i : i + piece], n) for d, at, ids, n in waiting for i in range(0, len(ids), piece)]
            found = []
            for b in windows([len(c[2]) for c in cut], capacity):
                offset = 0
                for i in sorted(b):
                    d, at, ids, n = cut[i]
                    found.append((d, at, ids, n, base + serial, offset))
                    offset += len(ids)
                serial += bool(b)
            waiting, held = [], 0
            return found

        key = pa.int64()
        names = [doc_id, *(n for n, _ in OUT), *["ids"] * carry_ids]
        for batch in batches:
            key = batch.schema.types[0]
            for at in range(0, batch.num_rows, 64):
                found = []
                part = batch.slice(at, 64)
                for d, text_ in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encode(text_ or ""), np.uint32(end_id)).astype("<u4")
                    full = len(ids) // capacity * capacity
                    for i in range(0, full, capacity):
                        found.append((d, i, ids[i : i + capacity], len(ids), base + serial, 0))
                        serial += 1
                    if full < len(ids):
                        waiting.append((d, full, ids[full:], len(ids)))
                        held += len(ids) - full
                    if held >= group_windows * capacity:
                        found += deal()
                if found:
                    yield rows(found)
        if waiting:
            yield rows(deal())

    ddl = f"`{doc_id}` {kept.dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n, _ in OUT) + ", ids array<bigint>" * carry_ids
    return docs.select(doc_id, F.col(text).cast("string").alias("_text_")).mapInArrow(run, ddl)


def padding(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Sequences, tokens and padded tokens of a packing; a sequence whose length is a power of two isn't padded."""
    fill = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return fill.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(F.bit_count("n") == 1, 0).otherwise(capacity - F.col("n"))).alias("padding"))
