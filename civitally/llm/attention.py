"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its bytes and
words (classes of bytes, pairs of classes, repetition); gated attention weights,
learned from document labels alone, say how much each passage counts; the
weighted mean of the encodings is scored. The model is fitted with numpy on at
most ``limit`` labelled documents (a parameter); every document is scored in one
Arrow pass with a model of a few thousand numbers.

Null and empty texts are one empty passage and get a score like others. Extra
columns are not read (``keep`` passes them through). Without labels of both
classes the score is their smoothed share of ones. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows
from .labelled import held_out, training_texts

FOLDS, FOLD, THRESHOLD = 4, 2, 0.7
PASSAGE = 800
#: Byte classes: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 sentence
#: marks, 5 bars, 6 symbols, 7 other ASCII, 8 other bytes.
CLASSES = 9
WIDTH = CLASSES * CLASSES + 5


def class_table() -> np.ndarray:
    out = np.full(256, 7, np.uint8)
    out[128:] = 8
    for number, members in enumerate(
        (range(97, 123), range(65, 91), range(48, 58), b" \t\n\x0b\x0c\r", b".,;:?!'\"", b"|",
         b"#*$%&<>@^~=_{}[]\\/+")
    ):
        out[list(members)] = number
    return out


TABLE = class_table()


def passages(text: str | None) -> list[bytes]:
    """A text in passages of about ``PASSAGE`` bytes, cut at white space where
    there is any within the next passage's length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out, at = [], 0
    while len(raw) - at > PASSAGE * 3 // 2:
        space = raw.find(b" ", at + PASSAGE, at + 2 * PASSAGE)
        end = space if space >= 0 else at + PASSAGE
        out.append(raw[at:end])
        at = end
    out.append(raw[at:])
    return out


def encode(passage: bytes) -> np.ndarray:
    """Shares of byte class pairs, and how much words repeat."""
    out = np.zeros(WIDTH, np.float32)
    if not passage:
        return out
    kinds = TABLE[np.frombuffer(passage, np.uint8)]
    if len(kinds) > 1:
        pairs = kinds[:-1].astype(np.int64) * CLASSES + kinds[1:]
        out[: CLASSES * CLASSES] = np.bincount(pairs, minlength=CLASSES * CLASSES) / len(pairs)
    words = passage.split()
    if words:
        n = len(words)
        out[-5] = len(set(words)) / n
        out[-4] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[-3] = min(len(passage) / n, 40) / 40
        out[-2] = sum(map(bytes.isupper, words)) / n
        out[-1] = min(n, 200) / 200
    return out


def bag(text: str | None) -> np.ndarray:
    return np.stack([encode(p) for p in passages(text)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Encoder, gated attention and classifier; ``constant`` without training."""

    def __init__(self, weights: dict[str, np.ndarray] | None, constant: float = 0.5):
        self.w, self.constant = weights, constant

    def forward(self, x: np.ndarray, starts: np.ndarray):
        w = self.w
        encoded = np.tanh(((x - w["mean"]) / w["scale"]) @ w["W"] + w["b"])
        content, gate = np.tanh(encoded @ w["V"]), sigmoid(encoded @ w["U"])
        energy = (content * gate) @ w["a"]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        power = np.exp(energy - np.maximum.reduceat(energy, starts)[owner])
        attention = power / np.add.reduceat(power, starts)[owner]
        pooled = np.add.reduceat(attention[:, None] * encoded, starts)
        score = sigmoid(pooled @ w["c"] + w["c0"])
        return score, (encoded, content, gate, attention, owner, pooled)

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        if self.w is None:
            return np.full(len(bags), self.constant)
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        return self.forward(np.concatenate(bags), starts)[0].astype(float)


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 250, units: int = 24,
        gates: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    ones = int(labels.sum())
    if ones in (0, len(labels)):
        return Model(None, (ones + 1) / (len(labels) + 2))
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags).astype(np.float32)
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    w = {
        "mean": x.mean(0), "scale": x.std(0) + 0.02,
        "W": rng.normal(0, 0.15, (x.shape[1], units)), "b": np.zeros(units),
        "V": rng.normal(0, 0.3, (units, gates)), "U": rng.normal(0, 0.3, (units, gates)),
        "a": rng.normal(0, 0.3, gates), "c": rng.normal(0, 0.3, units),
        "c0": np.array(np.log(ones / (len(labels) - ones))),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    model = Model(w)
    learned = ("W", "b", "V", "U", "a", "c", "c0")
    first = {k: np.zeros_like(w[k]) for k in learned}
    second = {k: np.zeros_like(w[k]) for k in learned}
    scaled = (x - w["mean"]) / w["scale"]
    for epoch in range(1, epochs + 1):
        score, (encoded, content, gate, attention, owner, pooled) = model.forward(x, starts)
        off = ((score - labels) / len(labels)).astype(np.float32)
        back = off[:, None] * w["c"]
        to_encoded = attention[:, None] * back[owner]
        to_attention = (encoded * back[owner]).sum(1)
        mean_back = np.add.reduceat(attention * to_attention, starts)
        to_energy = attention * (to_attention - mean_back[owner])
        to_gated = to_energy[:, None] * w["a"]
        to_content = to_gated * gate * (1 - content**2)
        to_gate = to_gated * content * gate * (1 - gate)
        to_encoded += to_content @ w["V"].T + to_gate @ w["U"].T
        to_input = to_encoded * (1 - encoded**2)
        slope = {
            "W": scaled.T @ to_input, "b": to_input.sum(0),
            "V": encoded.T @ to_content, "U": encoded.T @ to_gate,
            "a": (content * gate).T @ to_energy, "c": pooled.T @ off, "c0": off.sum(),
        }
        for k in learned:
            g = slope[k] + decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            step = (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.99**epoch)) + 1e-8)
            w[k] = (w[k] - rate * step).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = 4000) -> Model:
    """Fit on at most ``limit`` labelled documents outside the held out fold."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column("doc_id"),
            "label": batch.column("label"),
            "bag": [bag(t.as_py()).astype("<f4").tobytes() for t in batch.column("text")],
        }

    sample = training_texts(docs, labels, "quality", FOLDS, FOLD, limit)
    got = map_rows(sample, "doc_id bigint, label int, bag binary", rows).toPandas()
    got = got.sort_values(["doc_id", "bag"], kind="stable")
    bags = [np.frombuffer(bytes(b), "<f4").reshape(-1, WIDTH) for b in got["bag"]]
    return fit(bags, got["label"].to_numpy(dtype=np.float32))


def scores_of(model: Model, texts: list[str | None]) -> list[float]:
    out: list[float] = []
    for at in range(0, len(texts), 500):
        out += model.scores([bag(t) for t in texts[at: at + 500]]).tolist()
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = scores_of(model, batch.column("text").to_pylist())
        return {
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
            "score": found, "predicted": [int(s >= THRESHOLD) for s in found],
        }

    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(FOLDS, FOLD).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return map_rows(narrow, "doc_id bigint, held_out boolean, score double, predicted int", rows)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 500):
            found = scores_of(model, batch.column("text").to_pylist())
            yield batch.filter(pa.array([s >= THRESHOLD for s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
