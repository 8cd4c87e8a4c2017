"""Nodes of the trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from barloom.llm import prefix_trie, queries

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(said):
    """Nodes of {conv: [(role, text)]} as sorted tuples."""
    members = defaultdict(list)
    for c, turns in said.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    saved = {p: (len(m) - 1) * len(SPLIT.findall(p[-1][1])) if p else 0 for p, m in members.items()}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def under(p):
        return [p, *(x for c in children[p] for x in under(c))]

    out = []
    for p, m in members.items():
        below = under(p)
        ends = ",".join(map(str, sorted(c for c in m if len(said[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(children[p]), sum(not children[x] for x in below), sum(saved[x] for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def planted(seed, n=120):
    """Conversations that share beginnings, copies, prefixes of each other, and one that is long."""
    rng = random.Random(seed)
    rows, said = [], {}
    for c in range(n):
        size = 40 if c == 7 else rng.randrange(0, 6)
        turns = [("user" if i % 2 == 0 else "bot", rng.choice(["hi there", "yes", "no no no", "", "ünï 你 x"])) for i in range(size)]
        if c % 5 == 1 and said:
            turns = list(rng.choice(list(said.values())))
        if c % 7 == 2 and said:
            turns = said[7 if 7 in said else 0][: rng.randrange(0, 39)]
        said[c] = turns
        rows += [(c, i if i else None, r or None, t or None) for i, (r, t) in enumerate(turns)]
    return rows, {c: t for c, t in said.items() if t}


@pytest.mark.parametrize("range_turns", [500_000, 40])
def test_nodes_against_all_prefixes(spark, range_turns):
    rows, said = planted(5)
    table = spark.createDataFrame([*rows, (None, 1, "user", "no id")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("path", "conv", "depth", "range", "words")})
    assert got(prefix_trie.trie(prefix_trie.turns(table), range_turns)) == brute(said)


def test_every_range_boundary_gives_the_same(spark):
    """Forests of all ways to cut sorted paths in two or three, merged by hand-fed ranges, keep the sums."""
    rows, said = planted(6, 40)
    paths = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    for size in (1, 3, 9, 27):
        assert got(prefix_trie.trie(paths, size)) == brute(said)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    own = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", F.col("turn").asc_nulls_first()).collect():
        own[r.conv_id].append((r.role or "", r.text or ""))
    said = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        said[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    assert got(queries.op12_prefix_trie(spark, sf)) == brute(said)


def test_turnless_and_empty(spark):
    none = spark.createDataFrame([], "conv long, turns array<struct<digest:string,words:int>>")
    assert prefix_trie.trie(none).count() == 0
    two = spark.createDataFrame([(4, []), (3, [])], none.schema)
    assert got(prefix_trie.trie(two)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,4").hexdigest())]


def test_ties_of_turns_and_very_long_text(spark):
    rows = [(1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "b"), (3, None, None, "w " * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = got(prefix_trie.trie(prefix_trie.turns(table)))
    assert [r[:6] for r in out] == [(1, 0, None, 3, 2, 2), (1, 1, 1, 2, 1, 1), (1, 2, 1, 2, 0, 1), (3, 1, 1, 1, 0, 1)]
