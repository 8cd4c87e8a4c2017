"""Licence scanning with a generalised suffix automaton of licence tokens.

The automaton holds all substrings of the templates' word sequences. A text is streamed through it once; at each word
the length of the longest suffix that some template contains is the matching statistic. Maximal long matches are then
chained in template order into covered spans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Short phrases that name a licence, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wording of well-known licences and notices, by label.
TEMPLATES = {
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    "mit-notice": "this work is released under the mit license",
    "apache-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ),
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under the creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced",
}

#: Bytes of words stay (digits, letters lowered, all beyond ASCII); the others separate words.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class SuffixAutomaton:
    """States, their suffix links and lengths; for each state a place in a template where its strings end, and the phrases that end there."""

    def __init__(self, templates: list[list[bytes]], phrases: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[tuple[int, int]] = [(-1, 0)]
        for number, template in enumerate([*templates, *phrases]):
            last = 0
            for place, word in enumerate(template):
                last = self.extend(last, word, (number, place + 1))
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.phrases: list[tuple[int, ...]] = [()] * len(self.next)
        own: dict[int, list[int]] = {}
        for i, phrase in enumerate(phrases):
            state = 0
            for word in phrase:
                state = self.next[state][word]
            own.setdefault(state, []).append(i)
        for v in order[1:]:
            self.phrases[v] = (*own.get(v, ()), *self.phrases[self.link[v]])

    def state(self, length: int, ends: tuple[int, int], nexts: dict[bytes, int], link: int) -> int:
        for to, x in ((self.next, nexts), (self.link, link), (self.length, length), (self.ends, ends)):
            to.append(x)
        return len(self.next) - 1

    def extend(self, last: int, word: bytes, ends: tuple[int, int]) -> int:
        """Adds a word after the string of `last`; the usual construction, with the case that the string is there already."""
        q = self.next[last].get(word)
        if q is not None and self.length[q] == self.length[last] + 1:
            return q
        new = -1 if q is not None else self.state(self.length[last] + 1, ends, {}, 0)
        p = last
        while new >= 0 and p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][word]
        if self.length[q] > self.length[p] + 1:
            copy = self.state(self.length[p] + 1, self.ends[q], dict(self.next[q]), self.link[q])
            self.link[q] = copy
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = copy
                p = self.link[p]
            q = copy
        if new < 0:
            return q
        self.link[new] = q
        return new


def chain(matches: list[tuple[int, int, int, int]], gap: int) -> list[list[int]]:
    """[template, first word, end word, words covered, template words reached over] of runs of matches (template, template start, word start, length) in template order."""
    open_: dict[int, list[int]] = {}
    out = []
    for t, at, start, n in matches:
        c = open_.get(t)
        if c and start - c[2] <= gap and at >= c[5] - n and at + n > c[5]:
            fresh = n - max(0, c[2] - start)
            c[2], c[3], c[5] = start + n, c[3] + max(0, fresh), at + n
        else:
            if c:
                out.append(c)
            open_[t] = [t, start, start + n, n, at, at + n]
    return [c[:5] for c in [*out, *open_.values()]]


def scanner(least: int, gap: int, cover: float, texts: Sequence[tuple[str, str]] = tuple(TEMPLATES.items())) -> Callable[[str | None], tuple]:
    labels = [label for label, _ in texts]
    templates = [words(text) for _, text in texts]
    phrases = [p.encode().split() for p, _ in PHRASES]
    sam = SuffixAutomaton(templates, phrases)
    nexts, link, length, ends, marked = sam.next, sam.link, sam.length, sam.ends, sam.phrases
    known = {w for d in nexts for w in d}
    short = [len(p) for p in phrases]

    def of(text: str | None) -> tuple:
        w = words(text)
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int, int]] = []
        state = n = 0
        hits = [i for i, x in enumerate(w) if x in known]
        was = -2
        for i in [*hits, len(w) + 1]:
            if i != was + 1 and n:  # unknown words between: the match ends
                if n >= least and ends[state][0] < len(templates):
                    matches.append((ends[state][0], ends[state][1] - n, was + 1 - n, n))
                state = n = 0
            if i >= len(w):
                break
            x = w[i]
            if x not in nexts[state]:
                if n >= least and ends[state][0] < len(templates):
                    matches.append((ends[state][0], ends[state][1] - n, i - n, n))
                while state and x not in nexts[state]:
                    state = link[state]
                n = min(n, length[state])
            to = nexts[state].get(x)
            if to is not None:
                state, n = to, n + 1
                if marked[state]:
                    places += [(i + 1 - short[p], p) for p in marked[state] if short[p] <= n]
            was = i
        spans = []
        for t, start, end, covered, _ in chain(matches, gap):
            if covered >= min(len(templates[t]), max(least, cover * len(templates[t]))):
                spans.append((start, end, labels[t], covered / len(templates[t])))
        base = sorted({PHRASES[p][1] for _, p in places})
        starts = [s for s, _ in places]
        score = max([0.0, *(min(1.0, s[3]) for s in spans), *[0.5] * bool(places)])
        said = ",".join(f"{a}:{b}:{name}" for a, b, name, _ in sorted(spans))
        return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(s[2] for s in spans)})), score, said

    return of


COLUMNS = (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", "string"))


def template_rows(templates: DataFrame, label: str = "label", text: str = "text", most_chars: int = 20_000_000) -> list[tuple[str, str]]:
    """(label, text) of a table of licence texts, for the automaton that every task builds; over most_chars characters raise. Rows with a NULL or wordless text are left out."""
    rows = templates.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > most_chars:
        raise ValueError(f"{size} characters of templates; at most {most_chars} fit the automaton")
    return [(r["label"], r["text"]) for r in rows.orderBy("label", "text").collect() if words(r["text"])]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 4, gap: int = 12, cover: float = 0.3, templates: DataFrame | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every input row.

    `templates` is a table (label, text) of whole licences and notices; without one, a few well-known notices are used.
    Matches of `least` words or more are chained while they keep the template's order and lie within `gap` words; a
    chain that covers `cover` of its template becomes a span (first word:end word:label). Phrases are read off the same
    automaton: one ends at a word if its state is there or on the suffix-link path and the statistic is long enough.
    The score is the largest covered share, at least 0.5 with a phrase. NULL and empty texts have no words, empty
    labels, NULL places and score 0; repeated rows are judged alike. Of templates that share wording, the one added first names it.
    The templates' size is checked, so each task builds its own automaton. No shuffle.
    """
    texts = tuple(TEMPLATES.items()) if templates is None else tuple(template_rows(templates))
    return map_texts(docs, text, [doc_id], COLUMNS, lambda: scanner(least, gap, cover, texts))
