"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled 1; the other set is a sample of all web
text, whose labels are not looked at. With class prior p and logistic loss the
risk is p E_pos[loss(+)] + max(0, E_unl[loss(-)] - p E_pos[loss(-)]); where the
second term would turn negative, the step goes the other way. The prior is the
share of positives among the rows whose labels may be learned.

Features describe a text's form: shares of letter cases, digits and signs,
lengths, and how far words, pairs of words and lines repeat. Each is cut at
quantiles of the unlabelled sample, so the score can bend with it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import encoded, filter_rows, id_and_text, map_rows
from hangstats.llm.sampling import held_out, sample_ids, texts_of
from hangstats.llm.words import doc_of_word, mixed, words_of

#: Bounds of the two samples the model is fitted on.
POSITIVES, UNLABELLED = 6_000, 12_000
BINS, ROUNDS, RATE, RIDGE, STEP_BACK = 24, 700, 0.05, 3e-5, 1.0
THRESHOLD = 0.3

_SIGNS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b".", b",", b"#%&*$@^~=<>{}[]\\_+/", b"\n", b" "
)
FORM = (
    "upper", "digits", "exclaim", "bars", "stops", "commas", "signs", "lines", "spaces", "length", "words",
    "word_length", "distinct_words", "repeated_neighbours", "distinct_pairs", "distinct_triples", "distinct_lines",
)


class Model(NamedTuple):
    edges: np.ndarray  # (features, BINS - 1)
    weights: np.ndarray  # (features, BINS)
    bias: float


def _distinct(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return np.bincount(text[new], minlength=n)


def form_of(texts: list[str | None]) -> np.ndarray:
    """A row of features for each text; an empty one has zeros, and ones where a share of nothing repeats."""
    data = encoded(texts)
    words = words_of(data, marks_split=False, fold=False)
    n, sizes = len(texts), np.maximum(1, [len(d) for d in data])
    raw = np.frombuffer(words.data, dtype=np.uint8)
    columns = []
    for signs in _SIGNS:
        table = np.zeros(256, dtype=np.int64)
        table[list(signs)] = 1
        totals = np.concatenate([[0], np.cumsum(table[raw])])[words.offsets]
        found = np.diff(totals) - (signs == b"\n")  # the line feed between packed texts
        columns.append(found / sizes)
    text, count = doc_of_word(words), np.diff(words.first)
    many = np.maximum(count, 1)
    length = np.bincount(text, weights=(words.ends - words.starts), minlength=n)
    columns += [np.log1p(sizes), np.log1p(count), length / many, _distinct(text, words.hashes, n) / many]
    h, hashes = text, words.hashes
    same = (h[1:] == h[:-1]) & (hashes[1:] == hashes[:-1])
    columns.append(np.bincount(h[1:][same], minlength=n) / many)
    joined = hashes
    for _ in range(2):
        joined = mixed(joined[:-1] * np.uint64(3) + hashes[len(hashes) - len(joined) + 1 :]) if len(joined) else joined
        inside = h[len(h) - len(joined) :] == h[: len(joined)]
        columns.append(
            _distinct(h[: len(joined)][inside], joined[inside], n) / np.maximum(1, many - (len(h) - len(joined)))
        )
    lines = [len(set(d.split(b"\n"))) / (d.count(b"\n") + 1) for d in data]
    return np.column_stack([*columns, lines])


def binned(forms: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.column_stack([np.searchsorted(edges[i], forms[:, i], side="right") for i in range(len(edges))])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk by Adam over both samples at once."""
    width = len(FORM)
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((width, BINS - 1)), np.zeros((width, BINS)), float(np.log(prior / (1 - prior))))
    edges = np.quantile(unlabelled, np.arange(1, BINS) / BINS, axis=0).T
    offset = np.arange(width) * BINS
    p, u = binned(positive, edges) + offset, binned(unlabelled, edges) + offset
    w, bias = np.zeros(width * BINS), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def slope(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(rows.ravel(), np.repeat(by, width), len(w)), by.sum())

    for step in range(1, ROUNDS + 1):
        zp, zu = w[p].sum(axis=1) + bias, w[u].sum(axis=1) + bias
        sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        push = slope(u, su / len(u)) - prior * slope(p, sp / len(p))
        pull = prior * slope(p, (sp - 1) / len(p))
        g = pull + push if negative >= 0 else -STEP_BACK * push
        g[:-1] += RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model(edges, w.reshape(width, BINS), bias)


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    bins = binned(form_of(texts), model.edges)
    z = model.weights[np.arange(len(FORM)), bins].sum(axis=1) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _forms(docs: DataFrame, chosen: DataFrame) -> np.ndarray:
    def work(table: pa.Table) -> dict[str, list]:
        return {"form": form_of(table.column("text").to_pylist()).tolist()}

    found = map_rows(texts_of(id_and_text(docs), chosen.select("doc_id").distinct()), "form array<double>", work)
    return np.array([r["form"] for r in found.collect()], dtype=float).reshape(-1, len(FORM))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from bounded samples; labels of held-out rows and NULL labels are not used."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).filter(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)
    )
    count = known.agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    prior = ((count["good"] or 0) + 1) / (count["n"] + 2)
    ids = id_and_text(docs).select("doc_id").filter("doc_id is not null")
    return fit(
        _forms(docs, sample_ids(known.filter("quality = 1"), positives)),
        _forms(docs, sample_ids(ids, unlabelled)),
        prior,
    )


SCHEMA = "doc_id bigint, score double"


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Score of every whole text; NULL texts count as empty."""

    def work(table: pa.Table) -> dict[str, list]:
        return {
            "doc_id": table.column("doc_id").to_pylist(),
            "score": scores(table.column("text").to_pylist(), model),
        }

    return map_rows(id_and_text(docs), SCHEMA, work)


def keep_good(docs: DataFrame, model: Model, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``least``."""
    return filter_rows(docs, lambda texts: (scores(texts, model) >= least).tolist())
