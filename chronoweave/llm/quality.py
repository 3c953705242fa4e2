"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.bytehash import MARK, mix, token_hashes
from chronoweave.llm.sampling import is_held_out, training_rows
from chronoweave.llm.staging import Staging

#: Bound of the training sample: so many rows for each label at most.
SAMPLE_PER_LABEL = 3000
BITS = 18
EPOCHS = 4
THRESHOLD = 0.3
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def ngram_slots(text: str, bits: int = BITS) -> np.ndarray:
    """The slot of each word unigram and bigram of a whole text, repeats included.

    Words are runs of word characters or of marks. A word equal to the one before it is written as a
    repeat sign, so that stuttering looks alike whatever word it repeats; marks also count by kind
    alone. An empty text has no slot.
    """
    words, kinds, _ = token_hashes(text.encode())
    if not len(words):
        return np.zeros(0, np.int64)
    signs = words.copy()
    signs[1:][words[1:] == words[:-1]] = _REPEAT
    around = np.where(kinds == MARK, signs, np.uint64(1))
    grams = (signs, mix(signs[:-1] * np.uint64(3) + signs[1:]), mix(around[:-1] * np.uint64(5) + around[1:]))
    return (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights): the square roots of the slots' shares in all n-grams of the text."""
    slots, counts = np.unique(ngram_slots(text, bits), return_counts=True)
    return slots, np.sqrt(counts / max(1, counts.sum()))


@dataclass
class Ftrl:
    """FTRL-proximal (McMahan et al., "Ad Click Prediction: a View from the Trenches", 2013)."""

    size: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: float, share: float) -> None:
        """One step on an example that counts ``share`` times; the last slot is the constant."""
        at, x = np.append(slots, self.size), np.append(values, 1.0)
        w = self.weights(at)
        g = share * (_logistic(x @ w) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def fit(sample: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all slots and of the constant. The labels share the weight equally; without examples all are 0."""
    learner, order = Ftrl(1 << bits), np.random.default_rng(7)
    totals = np.bincount([label for *_, label in sample], minlength=2) if sample else np.ones(2)
    for _ in range(epochs):
        for k in order.permutation(len(sample)):
            slots, values, label = sample[k]
            learner.learn(slots, values, label, len(sample) / (2 * totals[label]))
    return learner.weights()


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, bits: int = BITS) -> np.ndarray:
    """Weights fitted to a sample of ``labels(doc_id, label)`` of 0 or 1 outside the held-out fold.

    The sample has ``per_label`` rows a label at most. Executors turn its texts into sparse vectors
    of 2 ** bits slots at most; those come to the driver, which fits.
    """

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [features(text, bits) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "slots": [s.astype(np.int32).tobytes() for s, _ in made],
                "weights": [w.astype(np.float32).tobytes() for _, w in made],
                "label": batch["label"].astype("int32"),
            })

    rows = training_rows(docs, labels.where("label in (0, 1)"), per_label)
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(vectors, f"doc_id {kind}, slots binary, weights binary, label int").toPandas()
    got = got.sort_values(["doc_id", "slots"], kind="stable")
    sample = [
        (np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(w, np.float32).astype(np.float64), int(y))
        for s, w, y in zip(got["slots"], got["weights"], got["label"], strict=True)
    ]
    return fit(sample, bits)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with quality_score, 0 to 1: the sparse dot product of text and weights, as a probability.

    Null and empty texts have no n-gram and get what the constant alone gives.
    """
    bits = int(np.log2(len(weights) - 1))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        table = shared.value
        out = []
        for text in texts:
            slots, values = features(text or "", bits)
            out.append(_logistic(float(values @ table[slots]) + float(table[-1])))
        return pd.Series(out, dtype="float64")

    return docs.withColumn("quality_score", scored(docs["text"]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``, by a model of ``labels(doc_id, label)``.

    Labels that are null or neither 0 nor 1 are ignored; with none left every score is 0.5.
    """
    Staging(docs.sparkSession, "quality")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns as they are."""
    Staging(docs.sparkSession, "quality")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    return score(held, train(docs, labels)).where(F.col("quality_score") >= threshold).select("doc.*")
