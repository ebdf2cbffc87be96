"""Toxicity by multiple-instance learning with noisy-or.

A document is a bag of sentences, and it is toxic if any sentence is:
``1 - product of (1 - s)`` over the sentences' scores ``s``. A sentence's score
is a logistic function of the words and word beginnings it holds. Only document
labels are used; fitting takes at most ``limit`` labelled documents (a
parameter) and the ``terms`` terms that speak most for toxicity among them.
``locate`` lists the sentences that offend.

Null and empty texts have no sentence: score 0. Without labels of both classes
there are no terms, and the score is their smoothed share of ones. Extra columns
are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civitally.session import settle

from .common import map_rows
from .labelled import held_out, training_texts

FOLDS, FOLD, THRESHOLD = 5, 0, 0.5
SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\W][^.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6)


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends with a hyphen."""
    return [word] + [word[:n] + "-" for n in BEGINNINGS if len(word) > n]


class Model:
    def __init__(self, weights: dict[str, float], bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant
        self.of_word: dict[str, tuple[str, ...]] = {}

    def known(self, word: str) -> tuple[str, ...]:
        found = self.of_word.get(word)
        if found is None:
            if len(self.of_word) >= 500_000:
                self.of_word.clear()
            found = self.of_word[word] = tuple(t for t in terms_of(word) if t in self.weights)
        return found

    def logit(self, words: Iterable[str]) -> float:
        return self.bias + sum(self.weights[t] for t in {t for w in words for t in self.known(w)})

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """start, end and score of every sentence (code points)."""
        return [
            (m.start(), m.end(), 1 / (1 + np.exp(-self.logit(WORD.findall(m[0].lower())))))
            for m in SENTENCE.finditer(text or "")
        ]

    def score(self, text: str | None) -> float:
        if not text:
            return 0.0
        if self.constant is not None:
            return self.constant
        if any(map(self.known, set(WORD.findall(text.lower())))):
            logits = np.array([self.logit(WORD.findall(s.lower())) for s in SENTENCE.findall(text)])
        else:
            logits = np.full(len(SENTENCE.findall(text)), self.bias)
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))


def fit(bags: list[list[list[int]]], empty: np.ndarray, labels: np.ndarray, width: int,
        epochs: int = 300, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias. ``bags``: term numbers of each document's sentences that
    hold any; ``empty``: each document's number of other sentences."""
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    sentences = [s for b in bags for s in b]
    of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    term = np.array([t for s in sentences for t in s], dtype=np.int64)
    weights, bias = np.zeros(width), -6.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for epoch in range(1, epochs + 1):
        logit = bias + np.bincount(of, weights[term], len(sentences))
        # log(1 - s) = -softplus(logit); the document's log(1 - p) is their sum.
        clean = empty * np.logaddexp(0, bias) + np.bincount(
            owner, np.logaddexp(0, logit), len(bags)
        )
        p = -np.expm1(-clean)
        # d loss / d clean: 1 for clean documents, -(1 - p) / p for toxic ones.
        slope = np.where(labels > 0, -np.exp(-clean) / np.maximum(p, 1e-9), 1.0) / len(labels)
        s = 1 / (1 + np.exp(-logit))
        by_sentence = slope[owner] * s
        grad = np.append(
            np.bincount(term, by_sentence[of], width) + decay / len(labels) * weights,
            by_sentence.sum() + (slope * empty).sum() / (1 + np.exp(-bias)),
        )
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-10)
        weights -= step[:-1]
        bias -= step[-1]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, limit: int = 10_000, terms: int = 2000,
          counted: int = 50_000, least_strength: float = 10.0) -> Model:
    """The model fitted on at most ``limit`` labelled documents. Of the terms that toxic
    ones hold, the ``counted`` most held are counted in clean ones too; the
    ``terms`` strongest of them with more than ``least_strength`` (the part of
    chi-square that lies in toxic documents) get a weight."""
    sample = settle(training_texts(docs, labels, "toxic", FOLDS, FOLD, limit), "toxic-sample")

    def holders(batch: pa.RecordBatch) -> dict:
        found: Counter = Counter()
        for text in batch.column("text"):
            words = set(WORD.findall(text.as_py().lower()))
            found.update({t for w in words for t in terms_of(w)})
        return {"term": list(found), "toxic": list(found.values())}

    def others(wanted: set[str]):
        def rows(batch: pa.RecordBatch) -> dict:
            found: Counter = Counter()
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                if not label:
                    words = set(WORD.findall(text.as_py().lower()))
                    found.update({t for w in words for t in terms_of(w)} & wanted)
            return {"term": list(found), "clean": list(found.values())}

        return rows

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, 0.0, (toxic + 1) / (toxic + clean + 2))
    counts = (
        map_rows(sample.filter("label = 1"), "term string, toxic bigint", holders)
        .groupBy("term").agg(F.sum("toxic").alias("toxic")).filter("toxic >= 2")
    )
    # The terms most held by toxic documents: bounded, so they can be counted
    # among the clean ones in one pass.
    often = counts.orderBy(F.desc("toxic"), "term").limit(counted).toPandas()
    wanted = set(often["term"])
    in_clean = (
        map_rows(sample, "term string, clean bigint", others(wanted))
        .groupBy("term").agg(F.sum("clean").alias("clean")).toPandas()
    )
    table = often.merge(in_clean, "left", "term").fillna({"clean": 0})
    a, b = table["toxic"].to_numpy(float), table["clean"].to_numpy(float)
    expected = toxic * (a + b) / (toxic + clean)
    table["strength"] = np.where(a > expected, (a - expected) ** 2 / expected, 0.0)
    best = table[table["strength"] > least_strength].sort_values(["strength", "term"], ascending=[False, True])
    names = sorted(best["term"].head(terms))
    index = {t: i for i, t in enumerate(names)}

    def bag_rows(batch: pa.RecordBatch) -> dict:
        model = Model(dict.fromkeys(index, 0.0), 0.0)
        bags, empty = [], []
        for text in batch.column("text"):
            bag, none = [], 0
            for sentence in SENTENCE.findall(text.as_py()):
                words = set(WORD.findall(sentence.lower()))
                found = sorted({index[t] for w in words for t in model.known(w)})
                if found:
                    bag.append(found)
                else:
                    none += 1
            bags.append(bag)
            empty.append(none)
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bag": bags,
                "empty": empty}

    got = map_rows(sample, "doc_id bigint, label int, bag array<array<int>>, empty int",
                   bag_rows).toPandas().sort_values(["doc_id", "empty"], kind="stable")
    weights, bias = fit([[list(s) for s in b] for b in got["bag"]], got["empty"].to_numpy(float),
                        got["label"].to_numpy(), len(names))
    return Model({t: float(weights[i]) for t, i in index.items()}, bias)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(FOLDS, FOLD).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [model.score(t.as_py()) for t in batch.column("text")]
        return {
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
            "score": found, "predicted": [int(s >= THRESHOLD) for s in found],
        }

    return map_rows(_narrow(docs), "doc_id bigint, held_out boolean, score double, predicted int",
                    rows)


def locate(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end, score, sentence of every sentence that offends by itself."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "end", "score", "sentence")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if model.constant is None and text:
                for start, end, s in model.sentences(text):
                    if s >= THRESHOLD:
                        for k, v in zip(out, (doc_id, start, end, float(s), text[start:end])):
                            out[k].append(v)
        return out

    return map_rows(_narrow(docs), "doc_id bigint, start int, end int, score double, "
                                   "sentence string", rows)

