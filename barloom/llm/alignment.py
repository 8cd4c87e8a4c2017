"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Coarse cuts come from the tokenizers: character offsets of the one, spans of the other. They are byte
offsets where all characters are ASCII; elsewhere (characters of several bytes, byte-fallback tokens) the tokens' decoded
bytes refine them. Texts are cut at single spaces, where both tokenizers end a token whatever follows, so each different
piece is encoded and aligned once a block of documents.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, texts

#: A pair of ids as one long: the second tokenizer's id above, the first one's in so many bits below.
BITS = 20
#: A single space between characters that are no white space.
CUT = re.compile(r" (?<=\S )(?=\S)")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_level() -> dict[str, int]:
    """Characters that stand for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Pair:
    """Two tokenizers: a byte-level one of the tokenizers library, and one of sentencepiece with byte fallback."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        to_byte = byte_level()
        known = {i: token for token, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(to_byte.get(c, 0) for c in known.get(i, "")) for i in range(max(known) + 1)]
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        crossing = [p for p in map(self.b.id_to_piece, range(self.b.get_piece_size())) if "▁" in p.lstrip("▁")]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        if crossing or self.b.encode("a  b", return_type=str)[0][0] != "▁" or max(known) >= 1 << BITS:
            raise ValueError("texts can't be cut at spaces: a piece holds one within, or none is added in front")

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids_and_ends(self, spaced: Sequence[str]) -> tuple[list[list[int]], list[list[int]], list[list[int]], list[list[int]]]:
        """Of both tokenizers, for each piece: ids, and where tokens end by offsets and spans, in characters."""
        a = self.a.encode_batch(spaced, add_special_tokens=False)
        b = self.b.encode([p[1:] for p in spaced], return_type="offset_mapping", num_threads=1)  # the space in front is added there
        return [x.ids for x in a], [[end for _, end in x.offsets] for x in a], [x["ids"] for x in b], [[end + 1 for _, end in x["offsets"]] for x in b]


def flat(lists: Sequence[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and how many each list has."""
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Alignment:
    """The alignment of some pieces: counts and groups for each, and links as pairs of ids, piece after piece."""

    def __init__(self, pair: Pair, pieces: Sequence[str]):
        spaced = [" " + p for p in pieces]
        said = [p.encode() for p in spaced]
        sizes = np.fromiter(map(len, said), np.int64, len(said))
        chars = np.fromiter(map(len, spaced), np.int64, len(said))
        found = pair.ids_and_ends(spaced)
        self.whole = np.ones(len(pieces), dtype=bool)
        if any(b"".join(map(table.__getitem__, chain.from_iterable(ids))) != b"".join(said) for table, ids in ((pair.a_bytes, found[0]), (pair.b_bytes, found[2]))):
            for i, piece in enumerate(said):
                if any(b"".join(map(table.__getitem__, ids[i])) != piece for table, ids in ((pair.a_bytes, found[0]), (pair.b_bytes, found[2]))):
                    self.whole[i], sizes[i] = False, 0
                    for lists in found:
                        lists[i] = []
        base = np.concatenate(([0], np.cumsum(sizes)))

        def cut(ids: list[list[int]], ends: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """ids, their ends in bytes of all pieces, ids a piece: coarse ends hold where each character is a byte, decoded bytes elsewhere."""
            i, n = flat(ids)
            return i, np.where(np.repeat(sizes == chars, n), flat(ends)[0] + np.repeat(base[:-1], n), np.cumsum(lengths[i])), n

        a, a_end, n_a = cut(*found[:2], pair.a_sizes)
        b, b_end, n_b = cut(*found[2:], pair.b_sizes)
        a_start = np.concatenate(([0], a_end[:-1])) if len(a_end) else a_end
        first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_end, a_end, "left")
        times = last - first + 1
        of = np.repeat(np.arange(len(a)), times)
        with_ = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        self.links = (b[with_] << BITS) | a[of]
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        piece_of = lambda ends: np.searchsorted(base, ends, "left") - 1
        n_links = np.bincount(np.repeat(piece_of(a_end), times), minlength=len(pieces)) if len(of) else np.zeros(len(pieces), dtype=np.int64)
        n_groups = np.bincount(piece_of(cuts), minlength=len(pieces)) if len(cuts) else np.zeros(len(pieces), dtype=np.int64)
        self.counts = np.stack([n_a, n_b, n_groups, n_links], axis=1).astype(np.int64)
        a_said, b_said = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_to, b_to = (np.searchsorted(ends, cuts, "right").tolist() for ends in (a_end, b_end))
        words, i, j = [], 0, 0
        for x, y in zip(a_to, b_to):
            words.append(f"{a_said[i] if x == i + 1 else ','.join(a_said[i:x])}|{b_said[j] if y == j + 1 else ','.join(b_said[j:y])}")
            i, j = x, y
        self.groups, at = [], 0
        for n in n_groups.tolist():
            self.groups.append(";".join(words[at : at + n]))
            at += n


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of small numbers, one length each, compressed."""
    head = np.array([len(x) for x in arrays], dtype="<u4").tobytes()
    return zstandard.compress(head + b"".join(x.astype("<u4").tobytes() for x in arrays), 1)


def unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    numbers = np.frombuffer(zstandard.decompress(blob), dtype="<u4").astype(np.int64)
    return np.split(numbers[n:], np.cumsum(numbers[:n])[:-1])


ALIGNED = "block bigint, part int, id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, packed binary, pairs array<bigint>, counts array<bigint>"
KINDS = (pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


class Numbers(dict):
    """Consecutive numbers for pieces, from zero."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class Block:
    """Documents of a task whose different pieces fit together."""

    def __init__(self, pair: Pair, number: int, carry: bool):
        self.pair, self.number, self.carry = pair, number, carry
        self.known = Numbers()
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.n_words = self.n_chars = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        pieces = CUT.split(" " + text) if text else []
        if pieces:
            pieces[0] = pieces[0][1:]
        known, before = self.known, len(self.known)
        at = np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))
        self.n_chars += len(text or "") if len(known) > before else 0
        self.n_words += len(pieces)
        self.docs.append((doc_id, at))

    def rows(self) -> Iterator[pa.RecordBatch]:
        pieces = list(self.known)
        parts, at, size = [], 0, 0
        gc.disable()  # millions of short lists without cycles
        for i, p in enumerate(pieces):  # so many characters at once
            size += len(p) + 16
            if size > 200_000 or i + 1 == len(pieces):
                parts.append(Alignment(self.pair, pieces[at : i + 1]))
                at, size = i + 1, 0
        gc.enable()
        counts = np.concatenate([np.zeros((0, 4), dtype=np.int64), *(p.counts for p in parts)])
        whole = np.concatenate([np.zeros(0, dtype=bool), *(p.whole for p in parts)])
        groups = [g for p in parts for g in p.groups]
        links = np.concatenate([np.zeros(0, dtype=np.int64), *(p.links for p in parts)])
        used = np.zeros(len(pieces), dtype=np.int64)
        for lo in range(0, len(self.docs), 256):
            out = []
            for doc_id, i in self.docs[lo : lo + 256]:
                if len(i) and whole[i].all():
                    kept, times = np.unique(i, return_counts=True)
                    used[kept] += times
                    said = ";".join([groups[x] for x in i.tolist()])
                    out.append((self.number, 0, doc_id, *counts[i].sum(axis=0).tolist(), hashlib.sha256(said.encode()).hexdigest(), said if self.carry else None, packed(np.diff(kept, prepend=0), times), None, None))
                else:
                    out.append((self.number, 0, doc_id, 0, 0, 0, 0, "", "" if self.carry else None, None, None, None))
            yield self.batch(out)
        pairs, which = np.unique(links, return_inverse=True)
        total = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(total, which, np.repeat(used, counts[:, 3]))
        some = np.flatnonzero(total)  # pieces of texts without tokens alone don't count
        place = np.zeros(len(pairs), dtype=np.int64)
        place[some] = np.arange(1, len(some) + 1)
        yield self.batch([(self.number, 1, None, *[None] * 6, packed(counts[:, 3], place[which]), pairs[some].tolist(), total[some].tolist())])

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS)], names=NAMES)


def aligned(docs: DataFrame, a_file: str, b_file: str, carry: bool, block_pieces: int, block_words: int) -> DataFrame:
    """A row for each row of (id, body), and one for each block: its pieces' links, its pairs and how often each is linked there."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = Pair(a_file, b_file), TaskContext.get().partitionId() << 32
        block = Block(pair, number, carry)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), texts(part, 1, 16)):
                    block.add(doc_id, text)
                    if len(block.known) >= block_pieces or block.n_words >= block_words or block.n_chars >= 64_000_000:
                        yield from block.rows()
                        number += 1
                        block = Block(pair, number, carry)
        if block.docs:
            yield from block.rows()

    return docs.mapInArrow(make, ALIGNED)


FINISHED = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"


def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block, with sums over their links of the corpus-wide counts."""
    place, total, best = (np.asarray(answers.column(c)) for c in ("place", "total", "best"))
    totals, bests = np.zeros(len(place) + 1, dtype=np.int64), np.zeros(len(place) + 1, dtype=np.int64)
    totals[place + 1], bests[place + 1] = total, best
    part = np.asarray(t.column("part"))
    n_links, which = unpacked(t.column("packed")[int(np.flatnonzero(part == 1)[0])].as_py(), 2)
    ends = np.concatenate(([0], np.cumsum(n_links)))
    summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[which])))[ends])
    of_total, of_best = summed(totals), summed(bests)
    docs = t.filter(pa.array(part == 0))
    n_best, count_sum = [], []
    for blob in docs.column("packed").to_pylist():
        kept, times = unpacked(blob, 2) if blob is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        kept = np.cumsum(kept)
        n_best.append(int(times @ of_best[kept]))
        count_sum.append(int(times @ of_total[kept]))
    out = {c: docs.column(c) for c in ("id", *COUNTS)}
    return pa.table({**out, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": docs.column("groups_sha256"), "groups": docs.column("groups")})


def align(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text", carry_groups: bool = False, block_pieces: int = 600_000, block_words: int = 8_000_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) for every row.

    Tokens of both tokenizers are linked where their bytes overlap, and grouped between offsets where both end. A
    pair's count is the number of links that hold it in all texts; n_best counts links whose pair is its second id's
    most frequent one, ties included. With carry_groups the groups themselves are returned (`a1,a2|b1;...`).
    A block of documents keeps its different pieces, at most about `block_pieces`, and asks once for the pairs
    that they hold; pairs are counted by Spark, as there can be as many as the vocabularies allow. NULL and empty texts,
    and texts whose tokens' bytes differ from theirs, have no tokens and count for no pair. Repeated rows count each;
    ids are read as longs and may be NULL; other columns, whatever their names, are not read. A very long text is one
    task's, and its pieces are encoded a few hundred thousand characters at a time, a piece without spaces as a whole.
    Empty tables give empty results. The tokenizers' files must be readable where tasks run.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body"))
    found = scratch.put(aligned(source, a_file, b_file, carry_groups, block_pieces, block_words))
    blocks = found.where("part = 1")
    counted = blocks.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total"))
    of_second = Window.partitionBy(F.shiftright("pair", BITS))  # at most as many rows as the first vocabulary has ids
    totals = scratch.put(scratch.put(counted).withColumn("best", (F.col("total") == F.max("total").over(of_second)).cast("int")))
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(totals, "pair").select("asker", "place", "total", "best")
    out = found.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(finish, FINISHED)
    return out.select(F.col("id").alias(doc_id), *COUNTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if carry_groups else []))
