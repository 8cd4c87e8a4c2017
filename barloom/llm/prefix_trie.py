"""A trie of conversations, built from sorted neighbours.

Different turn sequences are sorted over ranges. In a range, neighbours are edges as deep as their longest common prefix;
a union-find takes them in descending depth, and each merge of components creates (or widens) a branching node. A
range's forest is contracted to the nodes that it shares with its neighbours, and those are merged across boundaries.
All measures of a node are sums or minima over ranges, so one aggregation of the shared nodes finishes them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits that stand for a turn in a path.
TURN = 32
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = (
    ("depth", "long"), ("conv", "long"), ("parent_conv", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"),
    ("said", "long"), ("once", "long"), ("ends", "string"), ("open_id", "string"), ("open_parent", "string"),
)


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns array<struct<digest, words>>): each conversation's turns in order (NULL turn first; ties by digest).

    A turn is its role and text, NULL meaning empty, as half a SHA-256. Rows without a conversation's id are left out.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, TURN)
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("at"), digest.alias("digest"), F.regexp_count(said, F.lit(WORD)).alias("words")).where("conv IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("at").isNotNull().alias("known"), "at", "digest", "words")))
    return rows.groupBy("conv").agg(F.transform(ordered, lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def distinct_paths(rows: DataFrame) -> DataFrame:
    """(path, words, n, conv, ends) for each different path of (path, words, conv): members, the least of them, a digest of all.

    Members of a path come sorted and are streamed, so that a path of any number of members needs no memory.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, open_ = None, []
        sha = hashlib.sha256()

        def closed(done: list[list]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)], names=["path", "words", "n", "conv", "ends"])

        for b in batches:
            done = []
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                for p, w, c in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if p != path:
                        if path is not None:
                            done.append([*open_, sha.hexdigest()])
                        path, open_, sha = p, [p, w, 0, c], hashlib.sha256(str(c).encode())
                    else:
                        sha.update(f",{c}".encode())
                    open_[2] += 1
            if done:
                yield closed(done)
        if path is not None:
            yield closed([[*open_, sha.hexdigest()]])

    dealt = rows.select("path", "words", "conv").repartition("path").sortWithinPartitions("path", "conv")
    return dealt.mapInArrow(make, "path string, words array<int>, n bigint, conv bigint, ends string")


def shared_turns(a: str, b: str) -> int:
    d, most = 0, min(len(a), len(b)) // TURN
    while d < most and a[d * TURN : d * TURN + TURN] == b[d * TURN : d * TURN + TURN]:
        d += 1
    return d


def prefix_ids(path: str, depth: int) -> list[str]:
    """A digest of the path's first d turns, for d up to depth."""
    sha, out = hashlib.sha256(), []
    for d in range(depth + 1):
        if d:
            sha.update(path[(d - 1) * TURN : d * TURN].encode())
        out.append(sha.copy().hexdigest()[:TURN])
    return out


def merged(paths: list[str]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(depth, first, last, parent) of the paths' own nodes, one each, and of the branching nodes that merges create.

    Edges of equal depth go from left to right: then only the left component can have its top at that depth already.
    """
    depth = [len(p) // TURN for p in paths]
    first, last, parent = list(range(len(paths))), list(range(len(paths))), [-1] * len(paths)
    group, top = list(range(len(paths))), list(range(len(paths)))

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    edges = [shared_turns(a, b) for a, b in zip(paths, paths[1:])]
    for i in sorted(range(len(edges)), key=lambda i: (-edges[i], i)):
        a, b = find(i), find(i + 1)
        left, right = top[a], top[b]
        if depth[left] != edges[i]:
            for to, x in ((depth, edges[i]), (first, first[left]), (last, last[left]), (parent, -1)):
                to.append(x)
            parent[left] = len(depth) - 1
            left = parent[left]
        parent[right], last[left] = left, last[right]
        a, b = (a, b) if last[right] - first[right] < first[right] - first[left] else (b, a)  # the smaller one joins the larger
        group[b] = a
        top[a] = left
    return depth, first, last, parent


def forest(t: pa.Table, bounds: pa.Table) -> pa.Table:
    """The nodes of one range: finished, or with their part of the sums and open_id if a neighbouring range shares them."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("path", "words", "n", "conv", "ends"))), key=lambda r: r[0])
    before, after = (bounds.column(c)[0].as_py() if bounds.num_rows else None for c in ("before", "after"))
    paths = [r[0] for r in rows]
    from_left = -1 if before is None else shared_turns(before, paths[0])
    to_right = -1 if after is None else shared_turns(paths[-1], after)
    left_ids, right_ids = prefix_ids(paths[0], from_left), prefix_ids(paths[-1], to_right)
    depth, first, last, parent = merged(paths)
    members = [0]
    for r in rows:
        members.append(members[-1] + r[2])
    size = len(depth)
    least = [r[3] for r in rows] + [None] * (size - len(rows))
    children, leaves, said, once = [0] * size, [0] * size, [0] * size, [0] * size
    inner = set(parent)
    out: list[tuple] = []
    # branching nodes were created after what is below them, but a path's own node can be a parent too: by depth, then
    for x in sorted(range(size), key=lambda x: -depth[x]):
        n, up = members[last[x] + 1] - members[first[x]], depth[parent[x]] if parent[x] >= 0 else -1
        ends = rows[first[x]][4] if len(paths[first[x]]) == depth[x] * TURN else None
        below, spoken, alone = children[x], said[x], once[x]

        def open_id(d: int) -> str | None:
            if first[x] == 0 and 0 <= d <= from_left:
                return left_ids[d]
            return right_ids[d] if last[x] == len(rows) - 1 and 0 <= d <= to_right else None

        # a path that later ranges go on with is no leaf
        count = leaves[x] if x in inner or open_id(depth[x]) is not None else 1
        for d in range(depth[x], up, -1):
            goes_on = first[x] == 0 and d <= from_left
            words = rows[first[x]][1][d - 1] if d else 0
            spoken += n * words
            alone += 0 if goes_on else words
            inside = d - 1 > up
            own_parent = open_id(d - 1) if inside else None
            out.append((d, least[x], least[x] if inside and own_parent is None else None, n, below, count, spoken, alone, ends, open_id(d), own_parent))
            below, ends = 0 if goes_on else 1, None
        if parent[x] >= 0:
            p = parent[x]
            children[p] += below
            leaves[p] += count
            said[p] += spoken
            once[p] += alone
            least[p] = least[x] if least[p] is None else min(least[p], least[x])
            out[-1] = (*out[-1], p, x)
    # the parents' minima are known now
    final = []
    for row in out:
        if len(row) > len(NODE):
            *row, p, x = row
            d = depth[p]
            at_left, at_right = first[p] == 0 and d <= from_left, last[p] == len(rows) - 1 and d <= to_right
            row[2], row[10] = (None, left_ids[d] if at_left else right_ids[d]) if at_left or at_right else (least[p], None)
        final.append(row)
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.table({name: pa.array([r[i] for r in final], kinds[kind]) for i, (name, kind) in enumerate(NODE)})


def trie(paths: DataFrame, range_turns: int = 500_000) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    `paths` has (conv, turns) as turns() returns them; each different sequence of first turns is a node, from the root
    of depth zero, which exists unless there are no conversations. Repeated sequences are one path with many members.
    A range has about `range_turns` turns of different paths; a path, which is a digest for each turn, fits a task's
    memory, but no node's members, children or subtree must. A range shares at most two paths' nodes with others.
    """
    scratch = Scratch(paths.sparkSession)
    flat = paths.select(F.array_join(F.transform("turns", lambda x: x["digest"]), "").alias("path"), F.transform("turns", lambda x: x["words"]).alias("words"), "conv")
    found = scratch.put(distinct_paths(flat))
    total = found.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    ranges = max(1, math.ceil(total / range_turns))
    ordered = scratch.put(found.repartitionByRange(ranges, "path").sortWithinPartitions("path").withColumn("range", F.spark_partition_id()))
    in_order = Window.orderBy("range")  # a row for each range
    edges = ordered.groupBy("range").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    bounds = edges.select("range", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("after"))
    nodes = scratch.put(ordered.groupBy("range").cogroup(bounds.groupBy("range")).applyInArrow(forest, ", ".join(f"{n} {t}" for n, t in NODE)))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "said", "once")]
    shared = scratch.put(nodes.where("open_id IS NOT NULL").groupBy("open_id").agg(F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.max("ends").alias("ends"), F.first("open_parent").alias("open_parent"), *sums))
    above = shared.select(F.col("open_id").alias("open_parent"), F.col("conv").alias("parent_conv"))
    own = nodes.where("open_id IS NULL")
    columns = ("depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "said", "once", "ends")
    rows = own.where("open_parent IS NULL").select(*columns).unionByName(own.where("open_parent IS NOT NULL").drop("parent_conv").join(above, "open_parent").select(*columns)).unionByName(shared.join(above, "open_parent", "left").select(*columns))
    return rows.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("said") - F.col("once")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def with_borrowed_heads(rows: DataFrame, family: int, head: Column, most: int) -> DataFrame:
    """(conv, turns): the first `head` (at most `most`) turns come from the conversation that leads each `family` ids, the others are its own."""
    heads = rows.where(F.col("conv") % family == 0).select(F.col("conv").alias("lead"), F.slice("turns", 1, most).alias("lent"))
    joined = rows.withColumn("lead", F.col("conv") - F.col("conv") % family).join(heads, "lead", "left")
    nothing = F.slice("turns", 1, 0)
    lent = F.coalesce(F.slice("lent", F.lit(1), head), nothing)
    return joined.select("conv", F.concat(lent, F.slice("turns", head + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))
