"""Approximate nearest neighbours with learned partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.staging import Staging

NEAREST = 20
#: Bound of the sample that the partitions and the classifier are fitted to.
SAMPLE = 8192
MOST_PARTITIONS = 256
TARGET = 0.93
CHUNKS = {"v": 32768, "q": 4096}
_GRAPH = 16
_HIDDEN = 128
_EPOCHS = 25
#: One of so many rows of the sample is held out of the fit, and tells how many partitions to probe.
_HELD_OUT = 8


def balanced_partition(vectors: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each vertex of a neighbour graph, with few edges between parts and nearly equal parts.

    Starts from median cuts along the directions of largest spread; then vertices move to the part that
    most of their neighbours are in, best gain first, while it has room.
    """
    n = len(vectors)
    place = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        own, first, count = todo.pop()
        if count == 1 or len(own) < 2:
            place[own] = first
            continue
        middle = vectors[own] - vectors[own].mean(axis=0)
        axis = np.linalg.eigh(middle.T @ middle)[1][:, -1]
        left = count // 2
        order = own[np.argsort(middle @ axis, kind="stable")]
        cut = len(own) * left // count
        todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    room = int(np.ceil(1.05 * n / parts))
    for _ in range(rounds):
        votes = _votes(place, neighbours, parts)
        own = votes[np.arange(n), place]
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - own
        sizes, moved = np.bincount(place, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room:
                sizes[place[v]] -= 1
                sizes[best[v]] += 1
                place[v] = best[v]
                moved += 1
        if not moved:
            break
    return place


def _votes(place: np.ndarray, neighbours: np.ndarray, parts: int) -> np.ndarray:
    """How many neighbours of each vertex, in either direction, are in each part."""
    n, k = neighbours.shape
    votes = np.zeros(n * parts)
    np.add.at(votes, np.repeat(np.arange(n), k) * parts + place[neighbours.ravel()], 1)
    np.add.at(votes, neighbours.ravel() * parts + np.repeat(place, k), 1)
    return votes.reshape(n, parts)


def _neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product with each row, itself excluded."""
    out = np.zeros((len(vectors), k), np.int64)
    for start in range(0, len(vectors), 512):
        scores = vectors[start : start + 512] @ vectors.T
        scores[np.arange(len(scores)), start + np.arange(len(scores))] = -np.inf
        out[start : start + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


@dataclass
class Router:
    """A classifier with one hidden layer that gives each vector's partitions, most probable first."""

    parts: int
    probes: int
    layers: tuple[np.ndarray, ...] = ()

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(vectors), 1), np.float32)
        w1, b1, w2, b2 = self.layers
        scaled = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30)
        out = np.maximum(scaled.astype(np.float32) @ w1 + b1, 0) @ w2 + b2
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)

    def home(self, vectors: np.ndarray) -> np.ndarray:
        return self.probabilities(vectors).argmax(axis=1)

    def probed(self, vectors: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The partitions to probe for each vector: more than usual where those hold fewer than ``least`` rows."""
        order = np.argsort(-self.probabilities(vectors), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
        return [row[: max(self.probes, n)].astype(np.int32) for row, n in zip(order, enough, strict=True)]


def _learn(vectors: np.ndarray, wanted: np.ndarray, epochs: int = _EPOCHS) -> tuple[np.ndarray, ...]:
    """Weights by Adam on the cross entropy with the wanted distributions."""
    rng = np.random.default_rng(11)
    dim, parts = vectors.shape[1], wanted.shape[1]
    weights = [
        rng.normal(0, np.sqrt(2 / dim), (dim, _HIDDEN)).astype(np.float32) * 3, np.zeros(_HIDDEN, np.float32),
        rng.normal(0, np.sqrt(1 / _HIDDEN), (_HIDDEN, parts)).astype(np.float32), np.zeros(parts, np.float32),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        rate = 4e-3 * (1 - epoch / epochs)
        order = rng.permutation(len(vectors))
        for start in range(0, len(order), 256):
            x, y = vectors[order[start : start + 256]], wanted[order[start : start + 256]]
            hidden = np.maximum(x @ weights[0] + weights[1], 0)
            out = hidden @ weights[2] + weights[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            slope = (out / out.sum(axis=1, keepdims=True) - y) / len(x)
            back = (slope @ weights[2].T) * (hidden > 0)
            step += 1
            for k, g in enumerate((x.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(weights)


def fit(sample: np.ndarray, parts: int, target: float = TARGET, nearest: int = NEAREST) -> Router:
    """Partition the sample's neighbour graph, learn to route, and find how many partitions to probe.

    The classifier's shifts are set so that as many rows of the sample have each partition as their most
    probable one. The probes are the fewest with which, on average over vectors held out of the fit, the
    share ``target`` of their nearest in the rest lies in their most probable partitions. In all the data
    the nearest are nearer than those in a sample, so that this errs on the safe side.
    """
    if parts == 1 or len(sample) < 4 * max(_GRAPH, nearest):
        return Router(1, 1)
    asked, sample = sample[::_HELD_OUT], np.delete(sample, np.s_[::_HELD_OUT], axis=0)
    unit = (sample / np.linalg.norm(sample, axis=1, keepdims=True)).astype(np.float32)
    near = _neighbours(sample.astype(np.float32), _GRAPH)
    place = balanced_partition(unit, near, parts)
    wanted = _votes(place, near, parts) + 2 * (place[:, None] == np.arange(parts))
    router = Router(parts, parts, _learn(unit, (wanted / wanted.sum(axis=1, keepdims=True)).astype(np.float32)))
    logs = np.log(np.maximum(router.probabilities(sample), 1e-30))
    shift = np.zeros(parts)
    for _ in range(40):
        held = np.bincount((logs + shift).argmax(axis=1), minlength=parts)
        shift -= 0.2 * np.log((held + 1) / (len(sample) / parts + 1))
    router.layers = (*router.layers[:3], (router.layers[3] + shift).astype(np.float32))
    order = np.argsort(-router.probabilities(asked), axis=1, kind="stable")
    position = np.empty_like(order)
    np.put_along_axis(position, order, np.arange(parts)[None, :], axis=1)
    found = np.argpartition(-(asked @ sample.T), nearest - 1, axis=1)[:, :nearest]
    reached = np.take_along_axis(position, router.home(sample)[found], axis=1)
    share = (reached[:, :, None] < np.arange(1, parts + 1)).mean(axis=(0, 1))
    router.probes = int(np.argmax(share >= target)) + 1
    return router


def nearest_in_block(query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query row, id, score) of the k largest inner products of each query, ties to the smaller id; its own row aside."""
    out = []
    for q in range(len(queries)):
        if q % 64 == 0:
            scores = queries[q : q + 64] @ vectors.T
            scores[query_rows[q : q + 64, None] == rows[None, :]] = -np.inf
        row = scores[q % 64]
        floor = np.partition(row, len(row) - k)[len(row) - k] - 1e-9 if len(row) > k else -np.inf
        some = np.flatnonzero((row >= floor) & (row > -np.inf))
        # A product of matrices may round equal vectors differently; sums over a row don't.
        exact = (queries[q] * vectors[some]).sum(axis=1)
        best = np.lexsort((ids[some], -exact))[:k]
        out += [(int(query_rows[q]), int(i), float(s)) for i, s in zip(ids[some][best], exact[best], strict=True)]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v the components as doubles, without rows that can't be compared.

    Vectors that are null, empty or zero, that hold null or non-finite components, or have another
    length than most (ties: the longer) take no part, nor do rows without vec_id.
    """
    values = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("vec_id is not null and size(e) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = values.where(~F.exists("e", bad) & F.exists("e", lambda x: x != 0))
    most = good.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("e") == (most.n if most else 0))


def search(vectors: DataFrame, every: int = 20, nearest: int = NEAREST, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query among ``vectors(vec_id, embedding)``.

    Queries are rows whose vec_id is divisible by ``every``; all other rows are candidates, those with the
    query's vec_id too, and each of two query rows with one vec_id has its own nearest. Scores are inner
    products in double precision; ties go to the smaller vec_id. Every vector lies in its most probable
    partition, and a query is compared with all vectors of the partitions it probes: more of them, if
    those hold too few. Both sides of a partition are cut into chunks of bounded size, so that a
    partition with most of the rows is the work of many tasks. An empty table gives no row; of fewer
    candidates than ``nearest`` all are found.
    """
    spark = vectors.sparkSession
    staging = Staging(spark, "ann")
    rows = staging.write(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    count = rows.count()
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("e").collect()
    # Each probed partition offers its best to a query; so partitions are fewer than rows would ask for.
    parts = max(1, min(MOST_PARTITIONS, round(2 * count ** (1 / 3))))
    router = fit(np.array([x.e for x in taken], np.float64), parts, nearest=nearest)
    dim = len(taken[0].e) if taken else 0

    @F.pandas_udf("int")
    def home(values: pd.Series) -> pd.Series:
        return pd.Series(router.home(_matrix(values)).astype(np.int32))

    with staging.batches(4096):
        placed = staging.write(rows.withColumn("part", home("e")), "placed")
    held = np.zeros(router.parts, np.int64)
    for x in placed.groupBy("part").count().collect():
        held[x.part] = x["count"]

    @F.pandas_udf("array<int>")
    def probed(values: pd.Series) -> pd.Series:
        return pd.Series(router.probed(_matrix(values), held, nearest + 1))

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    with staging.batches(4096):
        asked = staging.write(queries.withColumn("probed", probed("e")).select("vec_id", "row", "e", F.explode("probed").alias("part")), "asked")
    chunks = {part: [max(1, -(-int(n) // CHUNKS["v"])), 1] for part, n in enumerate(held)}
    for x in asked.groupBy("part").count().collect():
        chunks[x.part][1] = -(-x["count"] // CHUNKS["q"])
    sizes = F.broadcast(spark.createDataFrame([(p, a, b) for p, (a, b) in chunks.items()], "part int, v_chunks int, q_chunks int"))

    def spread(table: DataFrame, own: str, other: str) -> DataFrame:
        chunk = F.pmod(F.xxhash64("row"), F.col(f"{own}_chunks")).cast("int").alias(f"{own}_chunk")
        others = F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1)).alias(f"{other}_chunk")
        return table.join(sizes, "part").select("part", "vec_id", "row", "e", chunk, others).groupBy("part", "v_chunk", "q_chunk")

    def compare(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(v) and len(q):
            mine, theirs = (_matrix(x["e"]).reshape(-1, dim) for x in (q, v))
            own, ids, other = (x.to_numpy(np.int64) for x in (q["row"], v["vec_id"], v["row"]))
            found = nearest_in_block(own, mine, other, ids, theirs, nearest)
        return pd.DataFrame(found, columns=["query_row", "vec_id", "score"])

    near = spread(placed, "v", "q").cogroup(spread(asked, "q", "v")).applyInPandas(compare, "query_row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    names = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.to_list(), np.float64)
