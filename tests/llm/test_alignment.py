"""Alignment of whole texts, token by token, against the operator's pieces."""

import functools
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  \n\n a  b \t c\r\n"), (5, "naïve 你好 😀😀 x́ ﬀ İstanbul"), (6, "<|endoftext|> <s> </s> <unk> <0x41> it's they'll 12 345,6 ..."),
    (7, "a ▁ b"), (8, "no▁piece"), (9, "nbsp here  em 　 wide \x1c sep \x85 nel line"), (10, "x" * 5000 + " " + "ab " * 3000), (None, "no id"), (5, "naïve 你好 😀😀 x́ ﬀ İstanbul"), (11, "\0 zero \x7f"), (12, "ends with space "),
]


@functools.cache
def tokenizers():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """[(id, start, end)] of both tokenizers over a whole text, from the bytes of each token; None where they differ."""
    if not text:
        return None
    t, s = tokenizers()
    said = (" " + text).encode()
    chars = alignment.byte_level()
    a = [(i, bytes(chars[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(s.id_to_piece(i)[3:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()) for i in s.encode(text)]
    if any(b"".join(x for _, x in side) != said for side in (a, b)):
        return None
    out = []
    for side in (a, b):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(rows):
    found = [(i, tokens(t)) for i, t in rows]
    linked, groups = [], []
    for _, both in found:
        links, said = [], []
        if both:
            a, b = both
            j = 0
            for i, lo, hi in a:
                while b[j][2] <= lo:
                    j += 1
                k = j
                while k < len(b) and b[k][1] < hi:
                    links.append((i, b[k][0]))
                    k += 1
            ends = sorted({x[2] for x in a} & {x[2] for x in b})
            at = 0
            for e in ends:
                said.append("|".join(",".join(str(i) for i, lo, hi in side if at <= lo and hi <= e) for side in both) if len(a) < 9000 else "")
                at = e
        linked.append(links)
        groups.append(said)
    counts = Counter(x for links in linked for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for (i, both), links, said in zip(found, linked, groups):
        a, b = both or ([], [])
        out.append((i, len(a), len(b), len(said), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(said).encode()).hexdigest() if both else ""))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("limits", [{}, {"block_pieces": 5}])
def test_odd_texts_against_whole_texts(spark, limits):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "block", "part", "pairs", "groups")})
    assert got(alignment.align(docs, A, B, **limits)) == brute(ODD)


def test_documents_against_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) > 150 and got(alignment.align(docs, A, B, block_pieces=3000)) == brute(rows)


def test_carried_groups_cover_the_text(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    pair = alignment.Pair(A, B)
    for r in alignment.align(docs, A, B, carry_groups=True).where("n_a > 0").collect():
        sides = [g.split("|") for g in r.groups.split(";")]
        a, b = (b"".join(table[int(i)] for g in sides for i in g[k].split(",")) for k, table in ((0, pair.a_bytes), (1, pair.b_bytes)))
        assert a == b and len(sides) == r.n_groups and hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
