"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text is
compressed with every dictionary, chunk by chunk and to its end, and the smallest total wins. The margin to the
runner-up is the score; a narrow one is grounds for rejection.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

UNDETERMINED = "und"
BETWEEN = re.compile(r"[\W\d_]+")
#: A score under this counts as too close to call.
REJECT_BELOW = 0.01


def plain(text: str) -> str:
    """Lower case, and one space for all between letters: layout and symbols don't tell languages apart."""
    return BETWEEN.sub(" ", text).lower()


def train(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", rows_per_lang: int = 128, chars_per_row: int = 1200, most_langs: int = 256) -> dict[str, bytes]:
    """A dictionary for each language of the rows where may_learn holds and lang isn't NULL.

    The sample is bounded: of each language the `rows_per_lang` different texts first by hash, and of each one
    excerpt of `chars_per_row` characters from a place that the hash chooses. Copies are merged before the limit, so a
    text with any number of them is one of the sample; only hashes are shuffled for that, merged within tasks first.
    NULL and empty texts and NULL languages teach nothing, and an empty table gives no dictionary.
    More than `most_langs` languages raise an error, since each costs a compression of every text.
    """
    t, h = F.col(text).cast("string"), F.xxhash64(F.col(text).cast("string"))
    start = (F.pmod(h, F.greatest(F.length(t) - chars_per_row, F.lit(1))) + 1).cast("int")
    rows = docs.where(may_learn & F.col(lang).isNotNull() & (F.length(t) > 0)).select(F.col(lang).cast("string").alias("lang"), h.alias("h"), F.substring(t, start, F.lit(chars_per_row)).alias("x"))
    texts = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= rows_per_lang)
    chosen = rows.join(F.broadcast(texts.select("lang", "h")), ["lang", "h"])  # rows_per_lang of each language
    found = sorted((r["lang"], r["h"], r["x"]) for r in chosen.groupBy("lang", "h").agg(F.min("x").alias("x")).toLocalIterator())
    out: dict[str, list[str]] = {}
    for name, _, x in found:
        out.setdefault(name, []).append(x)
    if len(out) > most_langs:
        raise ValueError(f"{len(out)} languages; at most {most_langs} are supported")
    return {name: " ".join(map(plain, xs)).encode() for name, xs in out.items()}


def classifier(dictionaries: dict[str, bytes], level: int = 3, chunk: int = 4096) -> Callable[[str | None], tuple[str, float]]:
    coders = []
    for name, content in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append((name, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False).compress))

    def of(text: str | None) -> tuple[str, float]:
        if not text or not coders or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        raw = plain(text).encode()
        pieces = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
        sizes = sorted((sum(len(f(p)) for p in pieces), name) for name, f in coders)
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        if sizes[0][0] < sizes[1][0]:
            return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]
        # a few words may compress alike everywhere; then the dictionary that holds most of them decides, narrowly
        tied = sorted((-sum(b" %b " % w in dictionaries[name] for w in raw.split()), name) for size, name in sizes if size == sizes[0][0])
        return tied[0][1], REJECT_BELOW * (tied[0][0] < tied[1][0])

    return of


def identify(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(id, kept columns, lang_pred, score): one row for each input row; `out` renames the last two where kept columns have their names.

    A NULL text, one without a letter, or any text when nothing was learned gets `und` and score 0. A tie goes to the
    language whose dictionary holds most of the words, with the least score that is accepted, or else to the first in
    code order with score 0. The score is the share of bytes saved against the runner-up, 0 to 1.
    The dictionaries hold at most languages x rows x characters of the training bounds, so they travel with the task.
    """
    cast = dict(dictionaries)
    return map_texts(docs, text, [doc_id, *keep], ((out[0], "string"), (out[1], "double")), lambda: classifier(cast))


def accepted(lang_pred: Column, score: Column, reject_below: float = REJECT_BELOW) -> Column:
    """Whether the prediction stands: a language, and by a margin that isn't narrow."""
    return (lang_pred != UNDETERMINED) & (score >= reject_below)
