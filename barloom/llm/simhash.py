"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is split into blocks so that close pairs share some; rows are joined on blocks and the Hamming distance
is verified. Equal fingerprints are one node, so copies are never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, marked, marks, texts

SEED = 42
#: The multipliers of the splitmix64 finaliser, which derives further hash words from the first.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15
#: Shingles that are counted at once, a multiple of 255.
FLUSH = 255 * 512

LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, k: int) -> bytes:
    """XXH64 of each k-word shingle (of the whole sequence if it is shorter), 8 bytes each."""
    w = text.encode().lower().split() if text else []
    if not w:
        return b""
    if len(w) <= k:
        return xxhash.xxh64_digest(b" ".join(w), SEED)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = xxhash.xxh64_digest
    return b"".join([of(line[a:b], SEED) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist())])


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hash word of that number, from the first."""
    if not word:
        return h
    x = h + np.uint64(word * STEP & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For rows of h that begin at each of `starts`: how often each of 64 bits is set. Up to 255 rows add up in byte lanes."""
    cuts = np.unique(np.concatenate([starts, np.arange(0, len(h), 255)]))
    lanes = np.add.reduceat(LANES[h.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    return np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.searchsorted(cuts, starts), axis=0)


def majority(hashes: list[bytes], n_words: int) -> np.ndarray:
    """Fingerprints of n_words 64-bit words, one row for each document; a bit is set if it is in over half the hashes."""
    sizes = np.array([len(x) // 8 for x in hashes], dtype=np.int64)
    out = np.zeros((len(hashes), n_words), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    h = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    for word in range(n_words):
        total = np.zeros((len(full), 64), dtype=np.int64)
        for at in range(0, len(h), FLUSH):  # a long text is counted in pieces
            last = min(at + FLUSH, len(h))
            first = np.searchsorted(starts, at, "right") - 1
            rows = slice(first, np.searchsorted(starts, last, "left"))
            total[rows] += bit_counts(mixed(h[at:last], word), np.maximum(starts[rows] - at, 0))
        bits = (2 * total > sizes[full, None]).astype(np.uint8)
        out[full, word] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, n_words: int = 1) -> DataFrame:
    """(id, fp array<long>) for every row: one pass, no shuffle. A NULL or wordless text has fingerprint zero."""
    kept = docs.schema[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, waiting, size = [], [], 0
            for t in texts(b, 1):
                waiting.append(shingle_hashes(t, k))
                size += len(waiting[-1]) // 8
                if size >= FLUSH:
                    found.append(majority(waiting, n_words))
                    waiting, size = [], 0
            found.append(majority(waiting, n_words))
            fps = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, fps.size + 1, n_words, dtype=np.int32), fps.ravel())], names=[doc_id, "fp"])

    return docs.select(doc_id, F.col(text).cast("string").alias("_text_")).mapInArrow(run, f"`{doc_id}` {kept.dataType.simpleString()}, fp array<bigint>")


def close_pairs(nodes: DataFrame, max_bits: int = 2, blocks: int = 4, hot: int = 48) -> DataFrame:
    """(a, b): links that connect the 64-bit fingerprints `fp` (distinct, long) just as all pairs within max_bits do.

    Pigeonhole: of `blocks` blocks at most max_bits hold a difference, so every close pair shares all of some
    blocks - max_bits blocks; each such choice is a join key. Blocks with up to `hot` fingerprints are joined with
    themselves and the distance is verified in the join. A larger block would be joined pairwise at quadratic cost;
    there the fingerprints are instead grouped by their variants with up to max_bits / 2 bits flipped: two
    fingerprints share a variant exactly if they are close, so linking each to the least of its group loses nothing.
    """
    if max_bits % 2 or blocks <= max_bits or 64 % blocks:
        raise ValueError("max_bits must be even and under the number of blocks, which must divide 64")
    width = 64 // blocks
    keep = [sum(((1 << width) - 1) << (width * i) for i in c) for c in combinations(range(blocks), blocks - max_bits)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    keys = F.array(*(F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(keep)))
    sized = nodes.select("fp", F.inline(keys)).withColumn("n", F.count("*").over(Window.partitionBy("p", "key"))).where("n > 1")
    cold = sized.where(F.col("n") <= hot).select("p", "key", "fp")
    other = cold.withColumnRenamed("fp", "other")
    near = cold.join(other, ["p", "key"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits))
    pairs = near.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    flips = [signed(sum(1 << i for i in c)) for r in range(max_bits // 2 + 1) for c in combinations(range(64), r)]
    crowd = sized.where(F.col("n") > hot).select("fp").distinct()
    variants = crowd.select("fp", F.explode(F.transform(F.lit(flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("v"))
    star = variants.withColumn("least", F.min("fp").over(Window.partitionBy("v"))).where("fp <> least")
    return pairs.union(star.select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): the 64-bit contract: documents within max_bits of each other are linked.

    component_id is the smallest id that a document reaches over links. Repeated rows keep a row each; NULL ids count
    for no smallest id, and a component with no other id has NULL. NULL, empty and wordless texts share fingerprint
    zero and are linked like any other. An empty table gives an empty result.
    """
    fps = Scratch(docs.sparkSession).put(fingerprints(docs, doc_id, text, k).select(F.col(doc_id).alias("id"), F.col("fp")[0].alias("fp")))
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least_id"))
    linked = connected_components(close_pairs(nodes.select("fp"), max_bits))
    named = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return fps.join(named.join(least, "component").select("fp", "component_id"), "fp").select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The hashes of a text's different shingles, ascending."""
    return np.unique(np.frombuffer(shingle_hashes(text, k), ">u8").astype(np.uint64)).view(np.int64)


def frequent_shingles(docs: DataFrame, k: int, one_in: int = 8, least: int = 3, most: int = 200_000) -> np.ndarray:
    """Shingles that are frequent in one of `one_in` texts, ascending: the most frequent ones, at most `most`, none if already those of the
    highest frequencies are more. They only decide an order, never a result. Frequencies are told apart by a fourth of a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, k) for t in texts(b, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("_text_"), F.lit(one_in)) == 0).select("_text_")
    scratch = Scratch(docs.sparkSession)
    counted = scratch.put(some.mapInArrow(run, "h bigint").groupBy("h").count().where(F.col("count") >= least))
    bucket, kept, total = F.floor(F.log2(F.col("count").cast("double")) * 4), None, 0  # of frequencies, without an upper end
    for r in sorted(counted.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["b"]):
        total += r["n"]
        if total > most:
            break
        kept = r["b"]
    chosen = counted.where(bucket >= kept).select("h").collect() if kept is not None else []
    found = np.sort(np.array([r["h"] for r in chosen], dtype=np.int64))
    scratch.drop(counted)
    return found


def prefixes(docs: DataFrame, k: int, similarity: float, last: np.ndarray) -> DataFrame:
    """(id, row, node, n, fp, keys) for each row: its set of n shingles by hash, the set's fingerprint, and the first of them in an order that puts `last` at the end.

    Two sets of that similarity share at least similarity * n, so they share one of the first n - ceil(similarity * n) + 1
    of each, whatever the order, as long as it is the same for all.
    """
    kept = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                node, n, keys, fps, waiting, size = [], [], [], [], [], 0
                for t in texts(part, 2):
                    s = shingle_set(t, k)
                    node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                    n.append(len(s))
                    waiting.append(s.astype(">i8").tobytes())
                    size += len(s)
                    if size >= FLUSH:
                        fps.append(majority(waiting, 1)[:, 0])
                        waiting, size = [], 0
                    if len(late) and len(s):
                        common = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                        s = np.concatenate([s[~common], s[common]])
                    keys.append(s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1])
                fps.append(majority(waiting, 1)[:, 0])
                ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(np.concatenate(fps).view(np.int64)), lists], names=["id", "row", "node", "n", "fp", "keys"])

    return docs.select("id", "row", "_text_").mapInArrow(run, f"id {kept}, row bigint, node bigint, n int, fp bigint, keys array<bigint>")


def fingerprint_pairs(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of `node` that connect all nodes (node, fp) whose fingerprints are within max_bits: the least node of
    a fingerprint with its others, and with the least ones of the fingerprints close to it."""
    scratch = Scratch(nodes.sparkSession)
    least = scratch.put(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    left, right = (least.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")) for c in ("a", "b"))
    close = close_pairs(least.select("fp"), max_bits).join(left, "a").join(right, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    out = scratch.put(same.union(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    scratch.drop(least)
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of two lists' sets have that Jaccard similarity, as a matrix.

    Overlaps are counted shingle by shingle: those in few sets of either list pair by pair, the others as a product
    of 0/1 matrices, some columns at a time. So neither the time nor the memory follows the number of different shingles.
    """
    n, m = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right)) if len(left) and len(right) else np.zeros(0, dtype=np.int64)
    if len(shared):

        def places(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(shingle number, set number) of the shared shingles, by shingle."""
            all_ = np.concatenate(sets)
            at = np.minimum(np.searchsorted(shared, all_), len(shared) - 1)
            hit = np.flatnonzero(shared[at] == all_)
            number, of = at[hit], np.repeat(np.arange(len(sets)), sizes)[hit]
            order = np.argsort(number, kind="stable")
            return number[order], of[order]

        (a, i), (b, j) = places(left, n), places(right, m)
        in_left, in_right = np.bincount(a, minlength=len(shared)), np.bincount(b, minlength=len(shared))
        rare = in_left * in_right * 300 <= len(left) * len(right)
        start = np.concatenate(([0], np.cumsum(in_right)))
        few = rare[a]
        times = in_right[a[few]]
        ends = np.cumsum(times)
        for lo in range(0, len(times), 1 << 14):
            t = times[lo : lo + (1 << 14)]
            base = np.concatenate(([0], np.cumsum(t)[:-1]))
            partner = j[np.repeat(start[a[few][lo : lo + (1 << 14)]] - base, t) + np.arange(t.sum())]
            np.add.at(overlap, (np.repeat(i[few][lo : lo + (1 << 14)], t), partner), 1)
        wide = np.flatnonzero(~rare)
        for lo in range(0, len(wide), 1024):
            column = np.full(len(shared), -1)
            column[wide[lo : lo + 1024]] = np.arange(len(wide[lo : lo + 1024]))
            of_left, of_right = np.zeros((len(left), 1024), dtype=np.float32), np.zeros((len(right), 1024), dtype=np.float32)
            for grid, number, which in ((of_left, a, i), (of_right, b, j)):
                c = column[number]
                grid[which[c >= 0], c[c >= 0]] = 1
            overlap += of_left @ of_right.T
    return overlap * (1 + similarity) >= similarity * (n[:, None] + m[None, :]) - 1e-6


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (a, b) that connect what all the marked ones between nodes of left and right do, fewer than there are nodes."""
    names, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    group = np.arange(len(names))
    a, b = (x for x in np.nonzero(links))
    a, b = place[: len(left)][a], place[len(left) :][b]
    while len(a):
        low = np.minimum(group[a], group[b])
        if (group[a] == group[b]).all():
            break
        np.minimum.at(group, group[a], low)
        np.minimum.at(group, group[b], low)
        while not np.array_equal(group, group[group]):
            group = group[group]
    moved = np.flatnonzero(group != np.arange(len(names)))
    return names[group[moved]].tolist(), names[moved].tolist()


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, hot: int = 32, chunk: int = 1 << 17, chunk_nodes: int = 512, max_bits: int = 2, wave: int = 1 << 24) -> DataFrame:
    """(id, component_id) where documents are linked exactly if their sets of k-word shingles have that Jaccard similarity.

    Equal sets are one node. Nodes are first linked by SimHash: pairs of fingerprints within max_bits, found by pigeonhole
    blocks and verified by whole sets. At that similarity fingerprints can be further apart, so a join completes the links,
    of which it verifies those between nodes that fingerprints don't connect: similar nodes share a shingle of their
    prefixes (see there). All pairs of a group that shares one are candidates if it has up to `hot` nodes; groups of the
    same nodes are paired once. In a larger group each node
    is first compared with the least one and then with the one with most links. Groups that these links don't connect
    are cut into chunks of bounded size, and chunks that meet in a group are compared as a whole within a task, which
    returns no more links than it has nodes: so their pairs are compared but never are rows. Chunks of one and the
    same component aren't compared. A chunk is sent once for each it meets, which grows with the square of a group; so the
    tasks are run in waves that send at most `wave` shingles, or a quarter of the input's if these are more, and leave no
    shuffle files to the next. Pairs are verified: sizes and prefixes bound the overlap from above, and what is
    left is compared by whole sets, as are chunks. Nothing depends on the number of documents. Wordless texts are one
    node; NULL ids count for no smallest id, and repeated rows keep a row each.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("_text_")).withColumn("row", F.xxhash64("id", "_text_"))
    found = scratch.put(prefixes(source, k, similarity, frequent_shingles(source, k)))
    full = scratch.put(found.groupBy("node").agg(F.min("id").alias("least_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    rows = scratch.put(found.select("id", "node"))
    scratch.drop(found)
    nodes = scratch.put(full.drop("keys"))

    def fits(n: Column, m: Column) -> Column:
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    def enough(overlap: Column) -> Column:
        return overlap * (1 + similarity) >= similarity * (F.col("n") + F.col("m")) - 1e-9

    def looked_up(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that can be similar by what s of a and t of b share, besides their rests. b's set is looked up once, not once a pair."""
        own = pairs.groupBy("b").agg(F.collect_set("a").alias("all")).join(sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("rest").alias("rest_b"), F.col("s").alias("t")), "b")
        likely = enough(F.size(F.array_intersect("s", "t")) + F.greatest("rest", "rest_b"))
        return own.select("b", "m", "rest_b", "t", F.explode("all").alias("a")).join(sets, (F.col("a") == F.col("node")) & likely).select("a", "b")

    def whole_sets(wanted: DataFrame) -> DataFrame:
        """(node, n, rest, s) for the nodes wanted, from the texts; nothing follows a whole set."""
        known = scratch.put(nodes.join(wanted, "node", "left_semi").select("row", "node", "n"))
        hit = scratch.put(marks(known.select(F.col("row").alias("h"))))
        likely = marked(source.select("row", "_text_"), F.col("row"), hit)  # else all texts would be dealt out
        found = likely.join(known, "row").dropDuplicates(["row"])  # a row has one node

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([shingle_set(t, k) for t in texts(part, 2)], pa.list_(pa.int64()))], names=["node", "n", "s"])

        out = scratch.put(found.select("node", "n", "_text_").mapInArrow(run, "node bigint, n int, s array<bigint>").select("node", "n", F.lit(0).cast("long").alias("rest"), "s"))
        scratch.drop(known, hit)
        return out

    def verified(pairs: DataFrame, close: DataFrame | None = None) -> DataFrame:
        """The pairs that are similar. Of `close` and pairs: first the close ones, by whole sets alone, then those that they leave unconnected."""
        likely = scratch.put(looked_up(pairs, short))
        asked = likely if close is None else likely.union(close)
        whole = whole_sets(asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct())

        def confirmed(some: DataFrame) -> DataFrame:
            return scratch.put(looked_up(some, whole))

        if close is None:
            out = confirmed(likely)
        else:
            by_fingerprint = confirmed(close)
            linked = scratch.put(connected_components(by_fingerprint))
            of_a, of_b = (linked.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b"))
            apart = likely.join(of_b, "b", "left").join(of_a, "a", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
            out = by_fingerprint.union(confirmed(apart.select("a", "b")))
            scratch.drop(linked)
        scratch.drop(likely, whole)
        return out

    close = fingerprint_pairs(nodes.where("n > 0").select("node", "fp"), max_bits)
    own = F.struct("node", "n")
    each = full.select("node", "n", F.explode("keys").alias("key"))
    sizes = scratch.put(each.groupBy("key").agg(F.count("*").alias("size"), F.min(own).alias("least")).where("size > 1"))
    met = scratch.put(each.join(sizes, "key"))
    scratch.drop(full, sizes)
    # a prefix's keys that no other node has count for no pair, so the rows of met are all that is kept of it; of the set whose
    # prefix ends first, all shared ones up to there are in both prefixes, and no more than its rest can follow
    short = scratch.put(met.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("key").alias("s")).select("node", "n", (F.ceil(similarity * F.col("n") - 1e-9) - 1).alias("rest"), "s"))
    small = met.where(F.col("size") <= hot).groupBy("key").agg(F.array_sort(F.collect_list(own)).alias("all")).select("all").distinct()
    before = F.transform("all", lambda c, i: F.transform(F.filter(F.slice("all", F.lit(1), i), lambda x: fits(x["n"], c["n"])), lambda x: F.struct(x["node"].alias("a"), c["node"].alias("b"))))
    crowd = met.where(F.col("size") > hot)
    star = crowd.where((F.col("least.node") != F.col("node")) & fits(F.col("least.n"), F.col("n"))).select(F.col("least.node").alias("a"), F.col("node").alias("b"))
    first = verified(small.select(F.inline(F.flatten(before))).union(star).distinct(), close)
    scratch.drop(close)

    def unconnected(links: DataFrame) -> DataFrame:
        """Rows of the larger groups that hold nodes which the links don't connect."""
        known = scratch.put(crowd.join(connected_components(links), "node", "left").select("key", "node", "n", "size", F.coalesce("component", "node").alias("group")))
        mixed = known.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
        out = scratch.put(known.join(mixed, "key"))
        scratch.drop(known)
        return out

    def within_crowds(first: DataFrame) -> DataFrame:
        """The links given, and those that the larger groups need besides."""
        if crowd.isEmpty():
            return first
        # a node with many links often connects what the least one doesn't, which saves comparisons
        degree = first.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        apart = unconnected(first)
        if apart.isEmpty():
            return first
        hub = scratch.put(apart.join(degree, "node", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "node", "n", "group")).alias("hub")))
        spokes = apart.join(hub, "key").where((F.col("hub.group") != F.col("group")) & fits(F.col("hub.n"), F.col("n"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
        second = scratch.put(first.union(verified(spokes.distinct())))
        scratch.drop(apart, hub)
        left = unconnected(second)
        if left.isEmpty():
            return second

        # a node's home is its largest group; large components there get chunks of their own
        home = scratch.put(left.groupBy("node").agg(F.max(F.struct("size", "key")).alias("home"), F.first("n").alias("n"), F.first("group").alias("group")))
        large = home.groupBy("home", "group").agg(F.count("*").alias("members")).where("members >= 64").select("home", "group", F.lit(True).alias("alone"))
        kinds = scratch.put(home.join(large, ["home", "group"], "left").select("home", "node", "n", "group", F.coalesce("alone", F.lit(False)).alias("alone"), F.when(F.col("alone"), F.col("group")).otherwise(0).alias("kind")))
        cut = kinds.groupBy("home", "alone", "kind").agg(F.greatest(F.ceil(F.sum("n") / chunk), F.ceil(F.count("*") / chunk_nodes)).cast("int").alias("parts"))
        chunks = scratch.put(kinds.join(cut, ["home", "alone", "kind"]).select("node", "n", "group", "alone", "kind", F.xxhash64("home", "alone", "kind", F.pmod(F.xxhash64("node"), "parts")).alias("chunk")))
        meets = scratch.put(left.select("key", "node").join(chunks, "node").select("key", "chunk", "alone", "kind").distinct())
        other = meets.select("key", F.col("chunk").alias("with"), F.col("alone").alias("alone_too"), F.col("kind").alias("kind_too"))
        tasks = scratch.put(meets.join(other, "key").where((F.col("chunk") <= F.col("with")) & ~(F.col("alone") & F.col("alone_too") & (F.col("kind") == F.col("kind_too")))).select("chunk", "with").distinct())
        whole = whole_sets(chunks.select("node"))
        members = scratch.put(chunks.join(whole, "node").select(F.col("chunk").alias("of"), "node", "group", "s"))
        scratch.drop(left, home, kinds, meets, whole)

        def sides(some: DataFrame) -> DataFrame:
            return some.select(F.struct("chunk", "with").alias("task"), F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("chunk").alias("of")), F.struct(F.lit(1).alias("side"), F.col("with").alias("of"))))).where("side = 0 or of <> task.chunk")

        sent = sides(tasks).join(chunks.groupBy(F.col("chunk").alias("of")).agg(F.sum("n").alias("n")), "of").agg(F.sum("n")).first()[0] or 0
        waves = math.ceil(sent / max(wave, nodes.agg(F.sum("n")).first()[0] // 4)) if sent > wave else 1

        def compare(t: pa.Table) -> pa.Table:
            """Links between the chunks of a task, or within its only one."""
            side, node, group = (np.asarray(t.column(c)) for c in ("side", "node", "group"))
            sets = [x.values.to_numpy() for x in t.column("s")]
            of = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
            of[1] = of[1] if len(of[1]) else of[0]
            links = similar_pairs([sets[i] for i in of[0]], [sets[i] for i in of[1]], similarity) & (group[of[0]][:, None] != group[of[1]][None, :])
            a, b = spanning(links, node[of[0]], node[of[1]])
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        out = second
        for i in range(waves):
            some = tasks if waves == 1 else tasks.where(F.pmod(F.xxhash64("chunk", "with"), F.lit(waves)) == i)
            out = out.union(scratch.put(sides(some).join(members, "of").groupBy("task").applyInArrow(compare, "a bigint, b bigint")))
        scratch.drop(chunks, tasks, members)
        return out

    linked = connected_components(within_crowds(first))
    component = nodes.join(linked, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    least = component.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_node = scratch.put(component.join(least, "component").select("node", "component_id"))
    scratch.drop(met, short, nodes)
    return rows.join(of_node, "node").select(F.col("id").alias(doc_id), "component_id")
