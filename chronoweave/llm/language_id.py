"""Language identification with string kernels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.sampling import is_held_out, training_rows
from chronoweave.llm.staging import Staging

#: Bounds of the training sample and of the landmarks: so many rows for each language at most.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 24
RIDGE = 1e-2
UNKNOWN = "und"
#: Width of the presence table of each length of n-gram, as a power of two.
_TABLES = {1: 8, 2: 12, 3: 13, 4: 14}
_WIDTH = sum(1 << bits for bits in _TABLES.values())
_ROWS = 128

_LETTERS = bytes(code if code >= 128 or chr(code).isalpha() else 32 for code in range(256))


def _mark(row: np.ndarray, text: str) -> None:
    """Mark the n-grams that a whole text has; bytes of ASCII other than letters count as blanks."""
    codes = np.frombuffer(text.lower().encode().translate(_LETTERS), np.uint8).astype(np.uint32)
    grams, at = codes, 0
    for n, bits in _TABLES.items():
        if n > 1:
            grams = grams[: len(codes) - n + 1] | (codes[n - 1 :] << np.uint32(8 * (n - 1)))
        if not len(grams):
            return
        slots = grams if bits == 8 else (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        row[at + slots] = 1
        at += 1 << bits


def presence(texts: list[str]) -> np.ndarray:
    """A row for each text: which byte n-grams of length 1 to 4 (hashed) the whole text has."""
    out = np.zeros((len(texts), _WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        _mark(row, text)
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The normalised blended-spectrum presence kernel: shared n-grams over the geometric mean of all."""
    sizes = np.sqrt(np.maximum(a.sum(axis=1), 1)[:, None] * np.maximum(b.sum(axis=1), 1)[None, :])
    return (a @ b.T) / sizes


@dataclass
class Model:
    """Landmark texts as presence rows, and weights from their kernels to each language."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest outputs, a row for each text."""
        return np.concatenate([kernel(presence(texts[k : k + _ROWS]), self.landmarks) @ self.weights for k in range(0, len(texts), _ROWS)])


def fit(marks: np.ndarray, languages: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression of +1 and -1 for each language on the Nyström features of the landmarks.

    ``marks`` has the presence rows of the texts as packed bits. The landmarks are the first of each language.
    """
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, _WIDTH), np.float32), np.zeros((0, 0)))
    rows = lambda at: np.unpackbits(marks[at], axis=1, count=_WIDTH).astype(np.float32)
    own = np.array(languages)
    chosen = np.concatenate([np.flatnonzero(own == name)[:landmarks] for name in names])
    lands = rows(chosen)
    values, vectors = np.linalg.eigh(kernel(lands, lands).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    gram, target = np.zeros((good.sum(), good.sum())), np.zeros((good.sum(), len(names)))
    wanted = np.where(own[:, None] == np.array(names)[None, :], 1.0, -1.0)
    for k in range(0, len(marks), _ROWS):
        part = kernel(rows(slice(k, k + _ROWS)), lands) @ whiten
        gram += part.T @ part
        target += part.T @ wanted[k : k + _ROWS]
    weights = whiten @ np.linalg.solve(gram + ridge * len(marks) * np.eye(len(gram)), target)
    return Model(names, lands.astype(np.uint8), weights.astype(np.float32))


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the text and non-null lang of a bounded sample of ``docs`` outside the held-out fold.

    Executors turn the sample's texts into presence rows; only those come to the driver, as packed bits.
    """

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = batch[batch["text"].map(has_letter).astype(bool)]
            bits = [np.packbits(presence([text])[0].astype(np.uint8)).tobytes() for text in some["text"]]
            yield pd.DataFrame({"doc_id": some["doc_id"], "label": some["label"], "marks": bits})

    rows = training_rows(docs, docs.select("doc_id", F.col("lang").alias("label")), per_language)
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("doc_id", "label")}
    got = rows.mapInPandas(marked, f"doc_id {kinds['doc_id']}, label {kinds['label']}, marks binary").toPandas().sort_values("doc_id", kind="stable")
    packed = np.frombuffer(b"".join(map(bytes, got["marks"])), np.uint8).reshape(len(got), -(-_WIDTH // 8))
    return fit(packed, got["label"].to_list())


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the struct column language(lang, score).

    A text that is null or has no letter, and every text when the model has no language, is ``und`` with
    score 0. The score is the winner's share of the outputs, each taken from -1..1 to 0..1; equal
    outputs go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def identified(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        if model.landmarks.dtype != np.float32:
            model.landmarks = model.landmarks.astype(np.float32)
        out = pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))})
        real = [k for k, text in enumerate(texts) if has_letter(text)]
        if real and model.languages:
            shares = np.clip((model.scores([texts.iloc[k] for k in real]) + 1) / 2, 1e-6, 1)
            best = shares.argmax(axis=1)
            out.loc[real, "lang"] = [model.languages[k] for k in best]
            out.loc[real, "score"] = (shares.max(axis=1) / shares.sum(axis=1)).astype(np.float64)
        return out

    return docs.withColumn("language", identified(docs["text"]))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs(doc_id, text, lang)``; see ``identify``."""
    Staging(docs.sparkSession, "language")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def keep_known(docs: DataFrame, reference: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a language learned from ``reference``, scored ``least`` or more; columns stay as they are."""
    Staging(docs.sparkSession, "language")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    found = identify(held, train(reference))
    return found.where((F.col("language.lang") != UNKNOWN) & (F.col("language.score") >= least)).select("doc.*")
