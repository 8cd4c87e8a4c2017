"""Repeated windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import substrings

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(id, n_words, n_removed, sha) as a multiset, from all windows in a dictionary."""
    words = [(i, SPLIT.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for at in range(len(w) - window + 1):
                k = tuple(w[at : at + window])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - window + 1):
            if i is not None and least[tuple(w[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = " ".join(x for at, x in enumerate(w) if at not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def planted(seed, n=60):
    """Texts that share passages in many contexts, copies, loops, and texts of one window."""
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, loop = text(75), text(7) * 20
    rows = []
    for i in range(n):
        w = text(rng.randrange(0, 120))
        kind = i % 6
        if kind < 3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(0, 20) : 75 - rng.randrange(0, 20)]
        elif kind == 3:
            w = loop[: rng.randrange(50, 140)] + w
        elif kind == 4 and rows:
            w = SPLIT.findall(rng.choice(rows)[1] or "")
        rows.append((rng.randrange(0, 2 * n), " ".join(w) if i % 11 else None))
    return [*rows, *rows[:3], (None, " ".join(passage)), (5, ""), (6, " \t\n ")]


@pytest.mark.parametrize("limits", [{}, {"shard_words": 500, "key_words": 200}])
def test_windows_against_brute_force(spark, limits):
    rows = planted(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "seg", "id", "h", "n", "runs", "kept")})
    out = substrings.dedup(docs, window=20, shingle=5, **limits)
    assert got(out) == brute(rows, 20)
    assert sum(r[2] for r in got(out)) > 1000


def test_kept_text_is_what_the_digest_says(spark):
    docs = spark.createDataFrame(planted(2), "doc_id long, text string")
    for r in substrings.dedup(docs, window=20, shingle=5).where("n_removed > 0").collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and len(r.kept.split()) == r.n_words - r.n_removed


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(substrings.dedup(docs)) == brute(rows, 50)


def test_empty_table_and_a_long_text(spark):
    docs = spark.createDataFrame([(1, "a b " * 40_000), (2, "a b " * 30_000 + "end")], "doc_id long, text string")
    assert [(r[0], r[1], r[2]) for r in got(substrings.dedup(docs))] == [(1, 80_000, 0), (2, 60_001, 60_000)]
    assert substrings.dedup(docs.where("1 = 0")).count() == 0


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 400), 0)
    order, _ = substrings.suffix_order(text, 8)
    index = substrings.FMIndex(text, order)
    for n in (1, 2, 4, 7):
        for at in range(0, 390, 13):
            pattern = text[at : at + n]
            lo, hi = np.array([0]), np.array([len(text)])
            for s in pattern[::-1]:
                lo, hi = index.extend(lo, hi, np.array([s]))
            assert hi[0] - lo[0] == sum((text[i : i + n] == pattern).all() for i in range(len(text) - n + 1))
