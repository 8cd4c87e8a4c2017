"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontam, langid, licenses, packing, prefix_trie, quality_model, quality_rules, secrets, simhash, substrings, suffix_tree
from .common import in_fold


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def learnable(n: int, held_out: int) -> Column:
    return F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), n, held_out)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality_rules.passes("base-1")).alias("base_failed"), quality_rules.passes("web-2").alias("kept"), "failed")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(read(spark, sf_dir, "documents"))
    number = {k: i for i, k in enumerate(secrets.KINDS)}
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == number[kind])).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.BASE))
    return rows.select("doc_id", *(of(k).alias(f"n_{k}") for k in secrets.BASE), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), F.to_json("credentials").alias("credentials"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs, learnable(4, 2)))
    return found.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", langid.accepted(F.col("lang_pred"), F.col("score")).alias("accepted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    out = chat.format_chats(rows.unionByName(extra)).select("conv_id", "valid", "segments", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.score(read(spark, sf_dir, "documents"), learnable(5, 1))
    return out.select("doc_id", in_fold(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learnable(5, 0))
    return out.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_trie.turns(read(spark, sf_dir, "conversations"))
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie.trie(prefix_trie.with_borrowed_heads(rows, 20, head, 3))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_secret_scan, op3_language_id, op4_chat_format, op5_lm_score, op6_simhash, op7_quality_model, op8_decontaminate, op9_pack, op10_license_scan, op11_substring_dedup, op12_prefix_trie, op13_token_alignment, pipeline)
}

WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT r, i, ws[i:i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits
  FROM w LEFT JOIN covered c USING (r)),
b AS (SELECT *, (CASE WHEN {quality_rules.RULES[0][2]} THEN 1 ELSE 0 END + {" + ".join(f"CASE WHEN {c} THEN {1 << bit} ELSE 0 END" for bit, _, c in quality_rules.RULES[1:])})::BIGINT AS failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM b
""",
    "op4_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS before,
  length('<|im_start|>') + length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AND last(role ORDER BY turn, role, text) = 'assistant' AS valid
FROM e GROUP BY conv_id
""",
    "op11_substring_dedup": rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS said FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
hit AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY said) AS least FROM g) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, i + k AS i, true AS gone FROM hit, range(0, 50) AS o(k)),
kept AS (SELECT r, count(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) AS said
  FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) LEFT JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
""",
    "op12_prefix_trie": rf"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, turn, substr(sha256(length(role) || ':' || role || said), 1, 32) AS k, len(regexp_extract_all(said, '{WORD}')) AS n FROM t),
p AS (SELECT c, k, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM k),
-- CRC-32 of the decimal digits, bit by bit
h AS (SELECT c, xor(list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')],
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS part, p.pos, k, n FROM h JOIN p ON p.c = h.c - h.c % 20 AND p.pos <= h UNION ALL SELECT h.c, 1, p.pos, k, n FROM h JOIN p ON p.c = h.c AND p.pos > h),
s AS (SELECT h.c, coalesce(list(k ORDER BY part, pos) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(n ORDER BY part, pos) FILTER (k IS NOT NULL), []) AS ns FROM h LEFT JOIN r USING (c) GROUP BY h.c),
m AS (SELECT c, d, array_to_string(ks[1:d], '') AS path, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], '') END AS above, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(ks) AS last FROM (SELECT c, ks, ns, unnest(range(0, len(ks) + 1)) AS d FROM s)),
v AS (SELECT path, d, any_value(above) AS above, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ids FROM m GROUP BY path, d),
b AS (SELECT above AS path, count(*) AS n FROM v WHERE above IS NOT NULL GROUP BY 1),
w AS (SELECT v.*, coalesce(b.n, 0) AS n_children FROM v LEFT JOIN b USING (path)),
u AS (SELECT substr(path, 1, 32 * e) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved FROM (SELECT path, n_children, saved, unnest(range(0, d + 1)) AS e FROM w) GROUP BY 1)
SELECT w.c AS conv_id, w.d AS depth, a.c AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM w JOIN u USING (path) LEFT JOIN v a ON a.path = w.above
""",
}
