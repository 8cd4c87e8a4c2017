"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text. The ledger keeps the measurements and one bit for each rule that failed;
policies are versioned sets of rules, applied later as a mask, and ablations are aggregates over the masks.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, words

MEASURES = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_lines", "long"), ("n_letters", "long"), ("n_capitals", "long"), ("n_digits", "long"))

# Characters that count as symbols, letters, capitals, digits and white space.
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = CAPITALS + CAPITALS.lower()
DIGITS = b"0123456789"
WHITE = b" \t\n\r\x0b\x0c"

#: Bit number, name and failure condition of each rule, as SQL over the measurements. A bit never changes its meaning.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > n_words"),
    (3, "capitals", "2 * n_capitals > n_letters"),
    (4, "repeated_lines", "2 * n_dup_lines > n_lines"),
    (5, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    (6, "digits", "10 * n_digits > 3 * word_chars"),
)

#: Versioned policies: the rules that a document must pass.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "capitals"),
    "web-2": ("few_words", "repeated_words", "symbols", "capitals", "repeated_lines", "word_length", "digits"),
}


def repeated(w: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    windows = list(zip(w, w[1:], w[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered, end = 0, 0
    for i, g in enumerate(windows):
        if seen[g] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.encode().strip(WHITE)]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return len(w), len(text or "") - without(WHITE), without(SYMBOLS), len(lines) - len(set(lines)), repeated(w), len(lines), without(LETTERS), without(CAPITALS), without(DIGITS)


def mask(names: tuple[str, ...]) -> int:
    bits = {name: bit for bit, name, _ in RULES}
    return sum(1 << bits[n] for n in names)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, measurements, failed): bit b of `failed` is set if rule b failed.

    One row for each input row, repeated ids included. A NULL text measures as an empty one: no words, so few_words
    fails and no ratio does. Other columns are ignored, whatever their names. An empty table gives an empty ledger.
    """
    measured = map_texts(docs, text, [doc_id], MEASURES, lambda: measure)
    failed: Column = F.lit(0).cast("long")
    for bit, _, condition in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", failed)


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy; no text is read again."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail nothing else (and so return without it), and what is kept with and without it.

    The ledger is first counted by bitmask, of which there are at most 2^rules, so that one small shuffle serves all rules.
    """
    of = mask(POLICIES[policy])
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(of)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in RULES if name in POLICIES[policy]))
    each = counts.select("m", "n", F.inline(rules))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    fails = F.col("m").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(total(fails).alias("fails"), total(F.col("m") == F.col("bit")).alias("fails_alone"), total(F.col("m") == 0).alias("kept"), total(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"))


def rule_bits(rows: DataFrame) -> DataFrame:
    """Over a whole ledger: the bits that some row fails, that every row fails, and how many failures there are."""
    return rows.agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), F.sum(F.bit_count("failed")).cast("long").alias("failures"))
