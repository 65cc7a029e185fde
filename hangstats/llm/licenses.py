"""Licence notices in texts: a positional index of rare template words.

Each template is a short notice. The words of all templates form a bounded
vocabulary; how many documents hold each of them is counted over the whole
table. A text whose key phrases allow a template is looked up by the rarest
words of that template that it has: their postings (template, position), set
against the positions in the text, vote for a place. A place with enough votes
is compared word by word and counts if enough of the template stands there and
its key phrases do. So many words of each template vote that no place that
counts lacks votes, however many notices a text has.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import encoded, id_and_text, map_rows
from hangstats.llm.words import Lookup, Words, words_of

#: Fixed by the contract: phrase and the label it stands for.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices as they are usually written, each with the phrases that must be there.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": ("released under the mit license", ("mit license",)),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license",)),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        ("gnu general public license", "version 3"),
    ),
    "gpl-2.0": (
        "this work is licensed under the gnu general public license version 2",
        ("gnu general public license", "version 2"),
    ),
    "lgpl": ("licensed under the gnu lesser general public license", ("lesser general public license",)),
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", ("affero general public license",)),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use", "source and binary forms"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ("for any purpose", "hereby granted"),
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
    "cc-by-4.0": ("this work is licensed under cc by 4 0", ("cc by", "licensed under")),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": (
        "licensed under a creative commons attribution sharealike license",
        ("creative commons attribution sharealike",),
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered", "public domain"),
    ),
    "all-rights-reserved": ("copyright all rights reserved", ("all rights reserved",)),
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {upper: upper + 32 for upper in range(65, 91)}
_SPLIT = {name: text.split() for name, (text, _) in TEMPLATES.items()}
_BASE = {tuple(phrase.split()): label for phrase, label in BASE_PHRASES.items()}
_KEYS = {name: [tuple(p.split()) for p in phrases] for name, (_, phrases) in TEMPLATES.items()}
#: No label without all words of one of these.
_NEEDED = [*_BASE, *{words for phrases in _KEYS.values() for words in phrases}]
VOCABULARY = frozenset(word for words in _SPLIT.values() for word in words)

#: At least so many of a template's rarest words are looked up; a place needs so many votes and so much of the template.
RARE_WORDS, LEAST_VOTES, LEAST_PART = 8, 2, 0.8


def words_looked_up(size: int) -> int:
    """So many that enough are left to vote when as many words of the template are missing as may be."""
    return max(RARE_WORDS, size - math.ceil(LEAST_PART * size) + LEAST_VOTES)


def words_in(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def phrase_starts(places: dict[str, list[int]], phrase: tuple[str, ...]) -> list[int]:
    """Places where the words of ``phrase`` stand consecutively; ``places``: positions of each word."""
    starts = set(places.get(phrase[0], ()))
    for i, word in enumerate(phrase[1:], 1):
        starts &= {at - i for at in places.get(word, ())}
        if not starts:
            break
    return sorted(starts)


_TERMS = sorted(VOCABULARY)


@functools.lru_cache(maxsize=1)
def _lookup() -> tuple[Lookup, list[str]]:
    """The vocabulary by hash."""
    found = words_of([term.encode() for term in _TERMS])
    order = np.argsort(found.hashes)
    return Lookup(found.hashes[order]), [_TERMS[i] for i in order]


def _vocabulary_hits(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts; text, position in it and vocabulary entry of each word in the vocabulary."""
    words = words_of(encoded(texts))
    at, term = _lookup()[0].hits(words.hashes)
    text = np.searchsorted(words.first, at, side="right") - 1
    return words, text, at - words.first[text], term


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """How many texts hold each template word, and the number of texts: one count over all rows.

    Only the sums for the words of the templates come to the driver.
    """

    def work(table: pa.Table) -> dict[str, list]:
        _, text, _, term = _vocabulary_hits(table.column("text").to_pylist())
        terms = _lookup()[1]
        counts = np.bincount(np.unique(text * len(terms) + term) % len(terms), minlength=len(terms))
        return {"word": ["", *terms], "n": [table.num_rows, *counts.tolist()]}

    rows = map_rows(id_and_text(docs), "word string, n bigint", work).groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {row["word"]: row["n"] for row in rows}
    return found, found.pop("", 0)


class LicenseIndex:
    """Postings of the template words with their weights."""

    def __init__(self, frequencies: dict[str, int], n_docs: int):
        self.idf = {w: math.log((1 + n_docs) / (1 + frequencies.get(w, 0))) for w in VOCABULARY}
        self.postings: dict[str, dict[str, list[int]]] = {name: defaultdict(list) for name in _SPLIT}
        for name, words in _SPLIT.items():
            for at, word in enumerate(words):
                self.postings[name][word].append(at)
        self.by_rarity = {
            name: sorted(found, key=lambda w: (-self.idf[w], w)) for name, found in self.postings.items()
        }

    def votes(self, name: str, places: dict[str, list[int]]) -> Counter[int]:
        """How many of the rarest words of a template speak for each start of it."""
        rare = [word for word in self.by_rarity[name] if word in places][: words_looked_up(len(_SPLIT[name]))]
        return Counter(at - place for word in rare for place in self.postings[name][word] for at in places[word])

    def matches(self, places: dict[str, list[int]]) -> list[tuple[str, int, float]]:
        """(template, start, part of its words in place) of the best accepted place of each template.

        Of places with the same part the one with most votes is best, then the first.
        """
        at_word: dict[int, str] = {}
        out = []
        for name, template in _SPLIT.items():
            keys = [phrase_starts(places, key) for key in _KEYS[name]]
            if not all(keys):
                continue
            at_word = at_word or {at: word for word, found in places.items() for at in found}
            votes, best = self.votes(name, places), None
            for start in {voted + shift for voted in votes for shift in (0, -1, 1)}:
                # A missing or added word shifts what follows, so neighbouring starts count too.
                if votes[start - 1] + votes[start] + votes[start + 1] < LEAST_VOTES:
                    continue
                low, high = start - 2, start + len(template) + 2
                if not all(bisect_left(found, low) < bisect_left(found, high) for found in keys):
                    continue
                in_place = sum(
                    any(at_word.get(start + i + shift) == word for shift in (0, -1, 1))
                    for i, word in enumerate(template)
                )
                part = in_place / len(template)
                if part >= LEAST_PART and (best is None or (part, votes[start], -start) > best):
                    best = part, votes[start], -start
            if best:
                out.append((name, -best[2], best[0]))
        return sorted(out)


SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, matches array<struct<label:string,start:bigint,part:double>>"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence labels of every whole text.

    A row for each row of ``docs``; NULL and empty texts have no words and no
    labels, repeated rows and NULL ids stay. The score is the largest part of a
    template in place, or 1.0 for a base phrase alone; 0.0 without any label.
    """
    index = LicenseIndex(*document_frequencies(docs))

    def work(table: pa.Table) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in (
            "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"
        )}
        words, text, position, term = _vocabulary_hits(table.column("text").to_pylist())
        terms = _lookup()[1]
        bounds = np.searchsorted(text, np.arange(table.num_rows + 1))
        for i, n_words in enumerate(np.diff(words.first).tolist()):
            own = slice(bounds[i], bounds[i + 1])
            present = {terms[t] for t in np.unique(term[own])}
            starts, labels, found = [], set(), []
            if any(present.issuperset(phrase) for phrase in _NEEDED):
                places: dict[str, list[int]] = defaultdict(list)
                for t, at in zip(term[own].tolist(), position[own].tolist(), strict=True):
                    places[terms[t]].append(at)
                for phrase, label in _BASE.items():
                    here = phrase_starts(places, phrase)
                    starts += here
                    labels |= {label} if here else set()
                found = index.matches(places)
            out["n_words"].append(n_words)
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | {name for name, _, _ in found})))
            out["score"].append(max([float(bool(labels)), *(part for _, _, part in found)]))
            out["matches"].append([{"label": n, "start": s, "part": p} for n, s, p in found])
        return out | {"doc_id": table.column("doc_id").to_pylist()}

    return map_rows(id_and_text(docs), SCHEMA, work)
