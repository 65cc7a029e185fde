"""Toxicity: a word classifier whose scores do not hang on which group a sentence names.

A bounded sample of labelled documents gives word hashes. The words that tell
the classes apart best, and all identity terms, are the features of a logistic
model. In every labelled sentence that names a group, the term is swapped for
each other term of its list, and left out; the squared change of the score is
added to the loss. With 0/1 features a swap changes the score by the difference
of two weights, so the penalty draws the weights of the terms to each other and
to zero: mentions alone do not decide, whatever the labels of the sample say.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import encoded, id_and_text, map_rows
from hangstats.llm.sampling import held_out, sample_ids, texts_of
from hangstats.llm.words import Lookup, Words, doc_of_word, words_of

#: Lists of terms that may take each other's place.
IDENTITY_TERMS = (
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish", "hindu"),
    ("women", "men", "woman", "man", "girls", "boys", "transgender", "nonbinary", "female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)
#: The model is fitted on at most so many labelled documents, and has so many word features.
SAMPLE_ROWS, FEATURES = 8_000, 2_048
RIDGE, COUNTERFACTUAL, ROUNDS, RATE = 3e-5, 1.0, 300, 0.1
THRESHOLD = 0.3
_SENTENCE_ENDS = np.isin(np.arange(256), list(b".!?\n"))


class Model(NamedTuple):
    hashes: np.ndarray
    weights: np.ndarray
    bias: float


class Example(NamedTuple):
    """Distinct word hashes of a document, and how often its sentences name each identity term."""

    label: int
    hashes: np.ndarray
    named: np.ndarray


def _identity_hashes() -> np.ndarray:
    return words_of([t.encode() for group in IDENTITY_TERMS for t in group]).hashes


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct words of each text, in order."""
    text = doc_of_word(words)
    order = np.lexsort((words.hashes, text))
    text, hashes = text[order], words.hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def sentences_naming(words: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for each sentence and term that it names."""
    order = np.argsort(terms, kind="stable")
    at, which = Lookup(terms[order]).hits(words.hashes)
    ends = np.cumsum(_SENTENCE_ENDS[np.frombuffer(words.data, dtype=np.uint8)])
    sentence = ends[words.starts[at]]
    pairs = np.unique(np.stack([doc_of_word(words)[at], sentence, order[which]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 2]


def examples(docs: DataFrame, chosen: DataFrame, label: str) -> list[Example]:
    """Word hashes of a bounded sample; the texts stay on the executors."""

    def work(table: pa.Table) -> dict[str, list]:
        words = words_of(encoded(table.column("text").to_pylist()))
        text, hashes = distinct_words(words)
        bounds = np.searchsorted(text, np.arange(table.num_rows + 1))
        named_text, named = sentences_naming(words, _identity_hashes())
        return {
            "label": table.column("label").to_pylist(),
            "hashes": [hashes[bounds[i] : bounds[i + 1]].tobytes() for i in range(table.num_rows)],
            "named": [named[named_text == i].astype(np.int32).tobytes() for i in range(table.num_rows)],
        }

    rows = texts_of(id_and_text(docs), chosen.withColumnRenamed(label, "label")).select("text", "label", "doc_id")
    found = map_rows(rows, "label int, hashes binary, named binary", work).collect()
    return [
        Example(r["label"], np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["named"], np.int32)) for r in found
    ]


def telling_words(rows: list[Example], most: int) -> np.ndarray:
    """Hashes of the words whose document counts differ most between the classes."""
    if not rows:
        return np.empty(0, np.uint64)
    vocabulary, index = np.unique(np.concatenate([r.hashes for r in rows]), return_inverse=True)
    labels = np.repeat([r.label for r in rows], [len(r.hashes) for r in rows])
    one = np.bincount(index, weights=labels, minlength=len(vocabulary))
    all_ = np.bincount(index, minlength=len(vocabulary))
    rate = np.mean([r.label for r in rows])
    strength = np.abs(one - rate * all_) / np.sqrt(np.maximum(rate * (1 - rate), 1e-6) * all_)
    strength[all_ < 2] = 0
    best = np.argsort(-strength, kind="stable")[:most]
    return vocabulary[best[strength[best] > 2.5]]


def swap_counts(rows: list[Example], of_term: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of features exchanged by swaps, -1 for a term left out, with the mean number of such swaps."""
    counts = np.bincount(np.concatenate([r.named for r in rows] or [np.empty(0, np.int32)]), minlength=len(of_term))
    start, found = 0, {}
    for group in IDENTITY_TERMS:
        for i in range(start, start + len(group)):
            for j in (*range(start, start + len(group)), -1):
                if i != j and counts[i]:
                    found[of_term[i], of_term[j] if j >= 0 else -1] = counts[i]
        start += len(group)
    pairs = np.array(list(found), dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], np.array(list(found.values()), dtype=float) / max(size, 1)


def fit(rows: list[Example], counterfactual: float = COUNTERFACTUAL) -> Model:
    """Logistic loss, ridge and the counterfactual penalty, by Adam over all examples at once.

    Without examples every text gets the score 0.
    """
    if not rows:
        return Model(np.empty(0, np.uint64), np.empty(0), -30.0)
    terms = _identity_hashes()
    features = np.unique(np.concatenate([telling_words(rows, FEATURES), terms]))
    lookup = Lookup(features)
    column, row = [], []
    for i, r in enumerate(rows):
        _, at = lookup.hits(r.hashes)
        column.append(at)
        row.append(np.full(len(at), i))
    column, row = np.concatenate(column), np.concatenate(row)
    labels = np.array([r.label for r in rows], dtype=float)
    left, right, often = swap_counts(rows, np.searchsorted(features, terms), len(rows))
    rate = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    w, bias = np.zeros(len(features)), float(np.log(rate / (1 - rate)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[column], minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        gradient = np.bincount(column, weights=error[row], minlength=len(w)) + RIDGE * w
        change = w[left] - np.where(right >= 0, w[right], 0)
        pull = 2 * counterfactual * often * change
        np.add.at(gradient, left, pull)
        np.add.at(gradient, right[right >= 0], -pull[right >= 0])
        g = np.append(gradient, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model(features, w, bias)


def scores(texts: list[str | None], model: Model, lookup: Lookup) -> np.ndarray:
    """Probability of label 1 for each whole text; each distinct word counts once."""
    words = words_of(encoded(texts))
    at, feature = lookup.hits(words.hashes)
    text = np.searchsorted(words.first, at, side="right") - 1
    pairs = np.unique(text * max(len(model.weights), 1) + feature)
    text, feature = pairs // max(len(model.weights), 1), pairs % max(len(model.weights), 1)
    z = np.bincount(text, weights=model.weights[feature], minlength=len(texts)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """A model from labelled rows that are not held out; NULL labels and ids teach nothing."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 4, 2)
    )
    return fit(examples(docs, sample_ids(known, most), "toxic"))


SCHEMA = "doc_id bigint, score double"


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Score of every whole text; NULL and empty texts get the score of a text without telling words."""

    def work(table: pa.Table) -> dict[str, list]:
        found = scores(table.column("text").to_pylist(), model, Lookup(model.hashes))
        return {"doc_id": table.column("doc_id").to_pylist(), "score": found}

    return map_rows(id_and_text(docs), SCHEMA, work)
