"""The pipeline's stages against brute force, and on odd inputs."""

import collections
import random
import re
from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import secrets

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
        if name != "pack":
            assert kept[-1].columns == columns
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:5]]
    assert len(rows[1]) > 0.97 * len(rows[0])
    sets = {i: shingles(t) for i, t in rows[1].items()}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():  # no two that stay are close, and each that went is near one
        near = [j for j, n in collections.Counter(j for x in s for j in by[x]).items() if j != i and n / len(s | sets[j]) >= 0.8]
        if i in rows[2]:
            assert not any(j in rows[2] for j in near)
        else:
            assert any(len(s & sets[j]) / len(s | sets[j]) >= 0.8 - 1e-9 for x in s for j in by[x] if j != i)
    passages = [r.text.strip().lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    went = set(rows[2]) - set(rows[3])
    whole = {i for i, t in rows[2].items() if any(p in t.lower() for p in passages)}
    assert whole <= went and all(any(p[at : at + 40] in rows[2][i].lower() for p in passages for at in range(0, len(p) - 39, 5)) for i in went - whole)
    assert set(rows[4]) == set(rows[3]) and not any(k < 3 for t in rows[4].values() for _, _, k, _ in secrets.parts(t))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = kept[5].agg(F.sum("length")).first()[0]
    assert n == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for x in rows[4].values())
    for k in kept:
        k.unpersist()


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words", "en", None, 3), (3, "some words", None, "s", 3), (3, "some words", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.where("1 = 0")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, SF)
            assert out.count() <= part.count() if name != "pack" else out.count() >= part.count()


def test_clashing_columns(spark):
    """Extra columns with names that the stages use themselves."""
    names = ("score", "lang_pred", "spans", "node", "row", "key", "keys", "item_id", "id", "component_id")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select("*", *(F.lit("x").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pack":
            assert out.columns == docs.columns and out.where("score <> 'x' or lang_pred <> 'x' or item_id <> 'x'").count() == 0
        assert out.count() > 0


def test_texts_are_dealt_out_once(spark):
    """The last step of the near-duplicate stage sends each text through one exchange; repeated rows and those without an id keep their meaning."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (1, "other words"), (None, "alone"), (None, "alone"), (None, None), (7, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))})
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be sent to every task
    try:
        plan = out.select("*")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = [x for x in re.findall(r"^\(\d+\) Exchange *\nInput \[\d+\]: \[(.*)\]", plan, re.M) if "text#" in x or "valueSet#" in x]  # whole rows, or their partial aggregates
    assert len(sent) == 1
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b c d e f"), (1, "other words"), (None, "alone"), (None, None)], key=str)


def test_single_texts_are_not_dealt_out(spark):
    """A text that has no near copy stays where it is read: the shuffle files of the last step are small beside the texts."""
    rng, dirs = random.Random(3), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    written = lambda: {f: f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}
    rows = [(i, " ".join(rng.randbytes(40).hex() for _ in range(100))) for i in range(400)]
    rows += [(400, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast(t) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_duplicates(spark, docs, SF)
        was = written()
        got = out.collect()
        new = sum(size for f, size in written().items() if f not in was)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([*rows[:400], (None, "alone")], key=str)
    assert new < 0.2 * sum(len(t) for _, t in rows)
