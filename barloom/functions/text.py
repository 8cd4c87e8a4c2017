"""Text and vector functions of the news features, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.entities import name2codepoint

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visit.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
# The weight of a source by its quality, and of an unknown one; the weight of a missing priority.
QUALITY_WEIGHTS = {"very_high": 1.2, "high": 1.0, "medium_high": 0.85, "medium": 0.7, "low": 0.5}
DEFAULT_QUALITY = 0.75
DEFAULT_PRIORITY = 0.75
# Terms of the lexicon sentiment, and its probabilities (positive, neutral, negative) by which terms prevail.
POSITIVE = ("rise", "rises", "higher", "gain", "bullish", "strong")
NEGATIVE = ("fall", "falls", "lower", "drop", "bearish", "weak")
PREVAIL = {"positive": (0.70, 0.20, 0.10), "negative": (0.10, 0.20, 0.70), "neither": (0.20, 0.60, 0.20)}
# Keywords of the risk themes, and the least scores that a category gives.
THEMES = {
    "geopolitical": ("war", "conflict", "sanction", "sanctions", "embargo", "tariff", "tariffs", "geopolitical", "opec", "russia", "ukraine", "middle east", "red sea", "strait", "attack", "export ban"),
    "supply": ("supply", "shortage", "disruption", "outage", "strike", "inventory", "inventories", "stockpile", "production cut", "output cut", "mine", "harvest", "crop", "export", "import", "refinery", "pipeline"),
    "weather": ("weather", "drought", "flood", "frost", "freeze", "hurricane", "storm", "heatwave", "rainfall", "el nino", "la nina", "wildfire"),
}
FLOORS = (
    (("oil", "natural gas", "lng", "energy", "energy transition"), {"supply": 0.35}),
    (("agriculture", "grains", "softs"), {"weather": 0.35, "supply": 0.25}),
)


def character(reference: Column) -> Column:
    """The character of a reference as it stands between & and ;, NULL for an unknown one. Names are the standard library's table."""
    named = F.create_map(*(F.lit(x) for name, code in name2codepoint.items() for x in (name, "\x20" if code == 160 else chr(code))), F.lit("apos"), F.lit("'"))
    digits = F.when(F.lower(reference).startswith("#x"), F.substring(reference, F.lit(3), F.length(reference))).otherwise(F.conv(F.substring(reference, F.lit(2), F.length(reference)), 10, 16))
    return F.when(reference.startswith("#"), F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).otherwise(F.try_element_at(named, reference))


def clean_html(c: Column) -> Column:
    """Tags (and the content of scripts and styles) and character references are removed only where there are some; white space is collapsed."""
    untagged = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^<>]*>", " ")
    found = F.array_distinct(F.regexp_extract_all(untagged, F.lit("&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    plain = F.aggregate(F.filter(found, lambda r: r != "amp"), untagged, lambda text, r: F.replace(text, F.concat(F.lit("&"), r, F.lit(";")), F.coalesce(character(r), F.concat(F.lit("&"), r, F.lit(";")))))
    marked = F.when(c.rlike(r"<[A-Za-z/!][^<>]*>|&[A-Za-z#0-9]+;"), F.replace(plain, F.lit("&amp;"), F.lit("&"))).otherwise(c)
    return F.trim(F.regexp_replace(marked, r"\s+", " "))


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters; the others keep their order and blank values."""
    bare = F.regexp_replace(F.trim(c), r"#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), r"\?.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    name = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING)), "&")
    return F.concat(F.lower(head), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def joined_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by |, NULL as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def article_text(title: Column, text: Column) -> Column:
    """Title and text, or the text alone if it holds the title."""
    t, x = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    return F.trim(F.when(F.contains(F.lower(x), F.lower(t)), x).otherwise(F.concat(t, F.lit(" "), x)))


def keyword_score(c: Column, terms: Sequence[str], full: int = 3) -> Column:
    """Terms found, as a share of `full`, at most 1: words at word borders, phrases anywhere.

    The pattern is tried only where the word occurs at all, which a plain search finds out at a fraction of its cost.
    """
    low = F.lower(F.coalesce(c, F.lit("")))
    hit = lambda t: (F.contains(low, F.lit(t)) if " " in t else F.contains(low, F.lit(t)) & low.rlike(rf"(?U)\b{t}\b")).cast("int")
    return F.least(sum((hit(t) for t in terms[1:]), hit(terms[0])) / F.lit(float(full)), F.lit(1.0))


def tokens(c: Column) -> Column:
    """Distinct lower-case tokens of three characters or more that begin with a letter."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z][a-zA-Z0-9_+-]{2,})"), F.lit(1)), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def theme_text(*parts: Column) -> Column:
    """The non-empty parts in lower case, underscores as spaces, joined by spaces."""
    low = [F.replace(F.lower(p), F.lit("_"), F.lit(" ")) for p in parts]
    return F.concat_ws(" ", *(F.when(p != "", p) for p in low))


def theme_scores(category: Column, *parts: Column) -> dict[str, Column]:
    """Score of each risk theme: its keywords in category and parts, and at least what the category gives."""
    text, name = theme_text(category, *parts), F.replace(F.lower(category), F.lit("_"), F.lit(" "))
    out = {}
    for theme, terms in THEMES.items():
        floors = [F.when(name.isin(*names), F.lit(of[theme])).otherwise(0.0) for names, of in FLOORS if theme in of]
        out[f"{theme}_theme_score"] = F.greatest(keyword_score(text, terms), *floors) if floors else keyword_score(text, terms)
    return out


def lexicon_sentiment(c: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """struct(positive, neutral, negative): fixed probabilities by which terms, found anywhere, prevail."""
    low = F.lower(F.coalesce(c, F.lit("")))
    count = lambda terms: sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    p, n = count(positive), count(negative)
    of = lambda i: F.when(p > n, PREVAIL["positive"][i]).when(n > p, PREVAIL["negative"][i]).otherwise(PREVAIL["neither"][i])
    return F.struct(of(0).alias("positive"), of(1).alias("neutral"), of(2).alias("negative"))


def normalised_scores(scores: Column) -> Column:
    """struct(positive, neutral, negative) from array<struct<label, score>>: the last score whose label holds the name.

    A lone label under 1 gives its rest to neutral, or, if it is neutral, half to each side; then all are scaled to sum to 1.
    """
    last = lambda name, *but: F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), F.transform(F.filter(scores, lambda x: _holds(x["label"], name, but)), lambda x: x["score"].cast("double"))), -1), F.lit(0.0))
    p, n, u = last("positive"), last("negative", "positive"), last("neutral", "positive", "negative")
    total = p + n + u
    alone = ((p > 0).cast("int") + (n > 0).cast("int") + (u > 0).cast("int") == 1) & (total < 1)
    rest = F.when(alone, 1 - total).otherwise(0.0)
    sided = (p > 0) | (n > 0)
    p2, n2, u2 = p + F.when(sided, 0.0).otherwise(rest / 2), n + F.when(sided, 0.0).otherwise(rest / 2), u + F.when(sided, rest).otherwise(0.0)
    share = lambda x: F.when(p2 + n2 + u2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (p2 + n2 + u2)))).otherwise(x)
    return F.struct(share(p2).alias("positive"), share(u2).alias("neutral"), share(n2).alias("negative"))


def _holds(label: Column, name: str, but: Sequence[str]) -> Column:
    found = F.contains(F.lower(label), F.lit(name))
    for other in but:
        found = found & ~F.contains(F.lower(label), F.lit(other))
    return found


def source_weight(quality: Column, priority: Column, weights: Mapping[str, float] = QUALITY_WEIGHTS) -> Column:
    """Weight by quality, in any case, times one that falls with the priority's number; 0.75 for either if unknown (a priority of 0 or less is)."""
    known = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    base = F.coalesce(F.try_element_at(known, F.lower(quality)), F.lit(DEFAULT_QUALITY))
    by_priority = F.when(priority > 0, F.greatest(F.lit(0.5), 1.2 - 0.1 * (priority - 1))).otherwise(DEFAULT_PRIORITY)
    return F.bround(base * by_priority, 6)


def description(*parts: Column) -> Column:
    """The non-empty parts, joined by full stops."""
    return F.concat_ws(". ", *(F.when(p != "", p) for p in parts))


def vector_json(v: Column) -> Column:
    return F.to_json(v.cast("array<double>"))


def vector_from_json(c: Column) -> Column:
    return F.from_json(c, "array<double>")


def freshness(published: Column, as_of: Column) -> Column:
    return 1 / (1 + F.greatest(F.datediff(as_of, published), F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if either norm is 0. Norms that are at hand already are taken as they are."""
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.try_divide(dot(a, b), lengths), F.lit(0.0))


def byte_buckets(c: Column, d: int = 8) -> Column:
    """UTF-8 bytes summed by place modulo d, scaled to length 1. Each byte is read once, in Arrow batches; NULL is like an empty text."""

    @F.pandas_udf("array<double>")
    def buckets(texts: pd.Series) -> pd.Series:
        raw = [b"" if t is None else t.encode() for t in texts]
        sizes = np.array([len(b) for b in raw], dtype=np.int64)
        of = np.repeat(np.arange(len(raw)), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        sums = np.bincount(of * d + place % d, np.frombuffer(b"".join(raw), np.uint8), minlength=len(raw) * d).astype(np.float64).reshape(len(raw), d)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return pd.Series(list(np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)), dtype=object)

    return buckets(c.cast("string"))
