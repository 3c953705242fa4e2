"""Toxicity by the nearest labelled examples: exact cosine of TF-IDF weighed by label, over a block-max inverted index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.bytehash import token_hashes
from chronoweave.llm.sampling import is_held_out, training_rows
from chronoweave.llm.staging import Staging

#: Bound of the labelled examples: so many rows for each label at most.
EXAMPLES_PER_LABEL = 2000
#: Bound of the examples of each label that the calibration is fitted to.
CALIBRATED_PER_LABEL = 500
NEAREST = 15
THRESHOLD = 0.5
BLOCK = 32
_PREFIXES = (4, 5, 6)
_SOFTEN = 0.05
#: Terms in more than this part of the examples have their postings in blocks.
_LONG = 12
_ROUND = 32
_TOGETHER = 64
_RANGE = 4096
_REMEMBERED = 10_000
#: More than single precision can err in a sum of products of two unit vectors' weights.
_ERROR = 1e-5


def all_terms(text: str) -> np.ndarray:
    """Hashed terms of a whole text, repeats included: lower-cased words, and the first 4, 5 and 6 bytes of longer ones."""
    words, _, heads = token_hashes(text.lower().encode(), _PREFIXES)
    return np.concatenate([words, *heads])


class Names:
    """Sorted hashes, found by their leading bits."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.bits = max(1, int(np.ceil(np.log2(max(2, len(names))))) + 1)
        heads = (names >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(heads, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max(initial=0))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are there, and the place of each of those."""
        head = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        place, end = self.start[head], self.start[head + 1]
        found = np.full(len(hashes), -1, np.int64)
        asked = np.flatnonzero(place < end)
        for k in range(self.longest):
            at = place[asked] + k
            met = self.names[at] == hashes[asked]
            found[asked[met]] = at[met]
            asked = asked[~met & (at + 1 < end[asked])]
            if not len(asked):
                break
        there = found >= 0
        return there, found[there]


class BlockMaxIndex:
    """Examples as unit vectors in an inverted index, in blocks that know each frequent term's largest weight."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]],
                 shares: np.ndarray, block: int = BLOCK, unknown: float = 1.0):
        """``terms`` sorted, with weights ``idf``; ``vectors`` hold term numbers and unit weights; ``shares`` weigh a vote of each label.

        ``unknown`` is the weight of a term that no example has.
        """
        self.terms, self.idf, self.block, self.shares, self.unknown = terms, idf, block, shares, unknown
        self.names = Names(terms)
        # Examples with the same strongest term come together, which keeps most block maxima low.
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = [k for k in sorted(range(len(vectors)), key=lambda k: (lead[k], k)) if lead[k] >= 0]
        bare = labels[[k for k in range(len(vectors)) if lead[k] < 0]].astype(int)
        weight = shares[bare] if len(bare) else np.zeros(0)
        stand = shares * np.bincount(np.asarray(labels, int), minlength=2)
        prior = (stand[1] + 0.5) / (stand.sum() + 1)
        self.blank = float((weight @ bare + prior * shares.min()) / (weight.sum() + shares.min()))
        self.ids, self.labels = [ids[k] for k in order], labels[order].astype(int)
        self.blocks = -(-len(order) // block)
        #: The vectors themselves, by which the cosines of the nearest are computed in the end.
        self.vectors = [vectors[k] for k in order]
        rows = np.concatenate([np.full(len(vectors[k][0]), place) for place, k in enumerate(order)] or [np.zeros(0)]).astype(np.int32)
        columns = np.concatenate([vectors[k][0] for k in order] or [np.zeros(0)]).astype(np.int32)
        weights = np.concatenate([vectors[k][1] for k in order] or [np.zeros(0)])
        # Long lists of postings lie in blocks, which may be passed over; short ones are read whole.
        df = np.bincount(columns, minlength=len(terms))
        often = np.flatnonzero(df * _LONG > len(order))
        self.place = np.full(len(terms), -1, np.int32)
        self.place[often] = np.arange(len(often))
        self.dense = np.zeros((self.blocks, len(often), block), np.float32)
        long = self.place[columns] >= 0
        self.dense[rows[long] // block, self.place[columns[long]], rows[long] % block] = weights[long]
        self.most = self.dense.max(axis=2).T.copy()
        rows, columns, weights = rows[~long], columns[~long], weights[~long]
        by_term = np.lexsort((rows, columns))
        self.rows, self.weights = rows[by_term], weights[by_term]
        self.start = np.searchsorted(columns[by_term], np.arange(len(terms) + 1))
        self.remembered: dict[bytes, tuple[float, list]] = {}
        self.slope, self.shift = 1.0, 0.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and weights of the terms of the index in a whole text; both empty if it has none.

        The weights are those of the text's unit vector, in which its other terms count as well.
        """
        hashes, counts = np.unique(all_terms(text), return_counts=True)
        known, place = self.names.find(hashes)
        weights = np.full(len(hashes), self.unknown)
        weights[known] = self.idf[place]
        return place, unit(counts, weights)[known]

    def nearest(self, numbers: np.ndarray, weights: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k examples nearest to a vector; those with cosine 0 don't count."""
        return self.nearest_of([(numbers, weights)], k)[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each of ``vectors``.

        Exact: short lists are summed whole. Those sums are lower bounds of the cosines, so a block is
        passed over for a vector when its upper bound doesn't reach the k-th best of them. Sums have
        single precision; all examples within its error of the k-th best are computed again in double.
        """
        size = self.blocks * self.block
        sums, heavy = np.zeros((len(vectors), size), np.float32), np.zeros((len(vectors), self.dense.shape[1]), np.float32)
        for row, dense, (numbers, weights) in zip(sums, heavy, vectors, strict=True):
            place = self.place[numbers]
            long = place >= 0
            dense[place[long]] = weights[long]
            own = numbers[~long]
            n = self.start[own + 1] - self.start[own]
            at = np.repeat(self.start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            row[:] = np.bincount(self.rows[at], self.weights[at] * np.repeat(weights[~long], n), minlength=size)
        bounds = sums.reshape(len(vectors), self.blocks, self.block).max(axis=2) + heavy @ self.most
        least = np.zeros(len(vectors), np.float32)
        for turn, b in enumerate(np.argsort(-bounds.sum(axis=0), kind="stable")):
            if turn % _ROUND == 0 and size > k:
                least = np.partition(sums, size - k, axis=1)[:, size - k]
            own = slice(b * self.block, (b + 1) * self.block)
            alive = (bounds[:, b] > 0) & (bounds[:, b] >= least - _ERROR)
            if alive.all():
                sums[:, own] += heavy @ self.dense[b]
            elif alive.any():
                sums[alive, own] += heavy[alive] @ self.dense[b]
                sums[~alive, own] = 0
            else:
                sums[:, own] = 0
        out, spread = [], np.zeros(len(self.terms))
        for row, (numbers, weights) in zip(sums, vectors, strict=True):
            found = np.flatnonzero(row)
            if len(found) > k:
                found = found[row[found] >= np.partition(row[found], len(found) - k)[len(found) - k] - _ERROR]
            spread[numbers] = weights
            cosines = np.array([spread[t] @ w for t, w in map(self.vectors.__getitem__, found)])
            spread[numbers] = 0
            best = np.lexsort((found, -np.round(cosines, 12)))[:k]
            out.append((found[best], np.minimum(cosines[best], 1.0)))
        return out

    def votes(self, texts: list[str]) -> list[tuple[float, list]]:
        """(score, evidence) of each text: the calibrated vote of the nearest examples, and (id, label, cosine) of each."""
        keys = [hashlib.md5(text.encode()).digest() for text in texts]
        if len(self.remembered) >= _REMEMBERED:
            self.remembered.clear()
        new = list({key: text for key, text in zip(keys, texts, strict=True) if key not in self.remembered}.items())
        for start in range(0, len(new), _TOGETHER):
            part = new[start : start + _TOGETHER]
            for (key, _), (found, cosines) in zip(part, self.nearest_of([self.vector(text) for _, text in part]), strict=True):
                score = float(_sigmoid(self.slope * _logit(self.vote(found, cosines)) + self.shift))
                self.remembered[key] = score, [(self.ids[i], int(self.labels[i]), float(c)) for i, c in zip(found, cosines, strict=True)]
        return [self.remembered[key] for key in keys]

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The share of label 1 among examples, weighed by nearness and by what an example stands for, and one prior vote."""
        share = self.shares[self.labels[found]] / (1 - cosines + _SOFTEN)
        one = self.shares.min()
        return float((share @ self.labels[found] + one * self.blank) / (share.sum() + one))

    def calibrate(self, per_label: int = CALIBRATED_PER_LABEL) -> None:
        """Fit the logistic curve from votes to scores on examples, taken by the hash of their ids, each voted on by all others.

        The fit (Platt 1999, with its softened targets) weighs examples as their label's rows in the
        population. It is left out when a label is missing or votes don't rise with the labels.
        """
        order = np.array(sorted(range(len(self.ids)), key=lambda k: hashlib.md5(f"vote {self.ids[k]}".encode()).digest()), int)
        own = np.concatenate([np.sort(order[self.labels[order] == y][:per_label]) for y in (0, 1)])
        if len(np.unique(self.labels[own])) < 2:
            return
        votes = []
        for start in range(0, len(own), _TOGETHER):
            part = own[start : start + _TOGETHER]
            for k, (found, cosines) in zip(part, self.nearest_of([self.vectors[k] for k in part], NEAREST + 1), strict=True):
                others = found != k
                votes.append(self.vote(found[others][:NEAREST], cosines[others][:NEAREST]))
        slope, shift = fit_logistic(_logit(np.array(votes)), self.labels[own], self.shares)
        if slope > 0:
            self.slope, self.shift = slope, shift


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve for ``labels`` over ``x`` by Newton's method, rows weighed by their label's share."""
    n = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight, inputs, beta = shares[labels], np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(inputs @ beta)
        slope = inputs.T @ (weight * (p - target)) + 1e-3 * beta
        bend = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta -= step * min(1, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf
    return weights / max(np.sqrt(weights @ weights), 1e-300)


def build(ids: list, labels: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], population: np.ndarray,
          frequencies: np.ndarray | None = None, documents: int | None = None) -> BlockMaxIndex:
    """An index of examples given as (term hashes, counts), distinct within an example.

    All their terms count. A term's weight is its idf times sqrt(1 + chi-square of its presence and the
    label), so that terms by chance keep their plain idf. ``population`` has the number of rows of each
    label, of which the examples are a sample. ``frequencies`` has in how many of ``documents`` each
    of ``vocabulary(terms)`` is; without it the examples are the documents. A term of no example
    gets the idf of one in a share 1 / (examples + 1) of the documents.
    """
    labels = np.asarray(labels, int)
    every = np.concatenate([t for t, _ in terms] or [np.zeros(0, np.uint64)])
    names, at = np.unique(every, return_inverse=True)
    owner = np.repeat(labels, [len(t) for t, _ in terms]) if len(terms) else np.zeros(0, int)
    with_term = np.stack([np.bincount(at[owner == y], minlength=len(names)) for y in (0, 1)]).astype(float)
    total = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    df, without = with_term.sum(axis=0), total[:, None] - with_term
    det = with_term[1] * without[0] - with_term[0] * without[1]
    chi2 = total.sum() * det**2 / np.maximum(df * without.sum(axis=0) * total[0] * total[1], 1)
    if frequencies is None:
        frequencies, documents = df, len(terms)
    weight = np.log1p(documents / np.maximum(frequencies, 1)) * np.sqrt(1 + chi2)
    vectors, start = [], 0
    for _, counts in terms:
        own = at[start : start + len(counts)]
        start += len(counts)
        vectors.append((own.astype(np.int32), unit(counts, weight[own])))
    return BlockMaxIndex(names, weight, ids, labels, vectors, population / np.maximum(total, 1), unknown=float(np.log1p(len(terms) + 1)))


def vocabulary(terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distinct term hashes of examples, sorted."""
    return np.unique(np.concatenate([t for t, _ in terms] or [np.zeros(0, np.uint64)]))


def document_frequencies(docs: DataFrame, names: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs(text)`` each of the sorted term hashes ``names`` is, and the number of rows.

    Each task counts in an array of the size of ``names``; the arrays are added by ranges of terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Names(names))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n = shared.value, 0
        counts = np.zeros(len(known.names) + 1, np.int64)
        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                counts[known.find(np.unique(all_terms(text or "")))[1]] += 1
        counts[-1] = n
        if n:
            ranges = range(0, len(counts), _RANGE)
            yield pd.DataFrame({"first": list(ranges), "counts": [counts[k : k + _RANGE].tobytes() for k in ranges]})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return pd.DataFrame({"first": rows["first"].iloc[:1], "counts": [total.tobytes()]})

    kind = "first long, counts binary"
    out = np.zeros(len(names) + 1, np.int64)
    for x in docs.select("text").mapInPandas(counted, kind).groupBy("first").applyInPandas(added, kind).collect():
        own = np.frombuffer(bytes(x.counts), np.int64)
        out[x.first : x.first + len(own)] = own
    shared.destroy()
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES_PER_LABEL) -> BlockMaxIndex:
    """The index of a bounded sample of ``labels(doc_id, label)`` of 0 or 1 outside the held-out fold."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [np.unique(all_terms(text), return_counts=True) for text in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "terms": [t.tobytes() for t, _ in made],
                "counts": [c.astype(np.int32).tobytes() for _, c in made],
                "label": batch["label"].astype("int32"),
            })

    known = labels.where("label in (0, 1)")
    rows = training_rows(docs, known, per_label)
    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(counted, f"doc_id {kind}, terms binary, counts binary, label int").toPandas()
    got = got.sort_values(["doc_id", "terms"], kind="stable")
    sizes = {x.label: x["count"] for x in known.where(~is_held_out(F.col("doc_id"))).groupBy("label").count().collect()}
    terms = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)) for t, c in zip(got["terms"], got["counts"], strict=True)]
    population = np.array([max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0))], float)
    index = build(got["doc_id"].to_list(), got["label"].to_numpy(int), terms, population, *document_frequencies(docs, vocabulary(terms)))
    index.calibrate()
    return index


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of ``docs``, by ``labels(doc_id, label)``.

    evidence lists (doc_id, label, cosine) of the examples that voted, nearest first. A null or empty
    text, as any without a term of the index, has none and the score of such examples. Without
    labels every score is 0.5.
    """
    Staging(docs.sparkSession, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf(f"score double, evidence array<struct<doc_id: {kind}, label: int, cosine: double>>")
    def voted(texts: pd.Series) -> pd.DataFrame:
        index, scores, evidence = shared.value, [], []
        for score, shown in index.votes([text or "" for text in texts]):
            scores.append(score)
            evidence.append([{"doc_id": i, "label": y, "cosine": c} for i, y, c in shown])
        return pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "evidence": pd.Series(evidence, dtype="object")})

    found = docs.select("doc_id", voted(docs["text"]).alias("vote"))
    return found.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("vote.score").alias("score"),
        (F.col("vote.score") >= threshold).cast("int").alias("predicted"),
        F.col("vote.evidence").alias("evidence"),
    )
