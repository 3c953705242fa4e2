"""SimHash near-dedup with vantage-point trees."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.bytehash import segments
from chronoweave.llm.components import connected_components
from chronoweave.llm.staging import Staging

WORDS = 3
RADIUS = 2
BLOCKS = 2
SHARD_ROWS = 16384
#: Bound of the fingerprints that the trees are built of.
SAMPLE = 1 << 20
#: A fingerprint with more than this part of all rows is frequent; so no more than so many are.
FREQUENT = 1000
LEAF = 512
_SEED = 42


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of the word shingles of a whole text, as a signed integer.

    Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` after A-Z became lower case. A text with
    fewer words than a shingle is one shingle; a text without words, or null, has fingerprint 0.
    """
    ones, n, held = np.zeros(64, np.int64), 0, []
    for piece in segments((text or "").encode()):
        held += piece.lower().split()
        if len(held) >= words:
            runs = zip(*(held[k:] for k in range(words)), strict=False)
            count = len(held) - words + 1
            ones += _bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(_SEED)), np.uint64, count))
            n += count
            held = held[count:]
    if not n:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(held), _SEED)).astype(np.int64)) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, in how many hashes it is set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(texts: Column) -> Column:
    """The fingerprint of each of ``texts``."""

    @F.pandas_udf("long")
    def made(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(text) for text in batch], dtype="int64")

    return made(texts)


def _masks(blocks: int) -> list[int]:
    """``blocks`` disjoint masks that cover 64 bits, of nearly equal width."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


class VantageTree:
    """A tree over the Hamming distance of the bits in ``mask``.

    Each inner node has a vantage point and the median distance of its sample from it; the inner
    child holds distances up to the median. ``leaves`` gives the leaves that a ball can touch: a child
    is left out when the triangle inequality shows that nothing in it is within the radius.
    """

    def __init__(self, sample: np.ndarray, mask: int, depth: int):
        self.mask, self.depth = np.uint64(mask), depth
        self.vantage = np.zeros((1 << depth) - 1, np.uint64)
        self.median = np.zeros((1 << depth) - 1, np.int64)
        place = np.zeros(len(sample), np.int64)
        for node in range((1 << depth) - 1):
            own = np.flatnonzero(place == node) if node else np.arange(len(sample))
            if len(own):
                self.vantage[node] = sample[own[0]]
                far = self._distance(sample[own], self.vantage[node])
                self.median[node] = int(np.median(far))
                place[own] = 2 * node + 1 + (far > self.median[node])

    def _distance(self, points: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count((points ^ others) & self.mask).astype(np.int64)

    def leaves(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, leaf) for each leaf that the ball of ``radius`` about a point can touch."""
        index, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            far = self._distance(points[index], self.vantage[node])
            inner, outer = far - radius <= self.median[node], far + radius > self.median[node]
            index, node = np.concatenate((index[inner], index[outer])), np.concatenate((2 * node[inner] + 1, 2 * node[outer] + 2))
        return index, node - (1 << self.depth) + 1


class _Forest:
    """Connected groups of the points of one shard."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def flat(self) -> np.ndarray:
        """The root of each point."""
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        roots, n = self.flat(), len(self.root)
        a, b = np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])
        apart = a < b
        for key in np.unique(a[apart] * n + b[apart]).tolist():
            i, j = self.find(key // n), self.find(key % n)
            self.root[max(i, j)] = min(i, j)


def _compare(points: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: _Forest) -> None:
    """Link all pairs of ``a`` and ``b`` within the radius, some rows at a time."""
    step = max(1, (1 << 20) // max(1, len(b)))
    for start in range(0, len(a), step):
        rows = a[start : start + step]
        near = np.bitwise_count(points[rows][:, None] ^ points[b][None, :]) <= radius
        i, j = np.nonzero(near)
        forest.link(rows[i], b[j])


def link_shard(points: np.ndarray, mask: int, radius: int, block_radius: int) -> np.ndarray:
    """The least member's place of the connected group of each of the distinct ``points``.

    Two points are linked when they differ in ``radius`` bits or fewer and in ``block_radius`` or fewer
    of the bits in ``mask``. The points are split about vantage points; two sides are compared only
    where they lie within the block radius of the boundary. Points at one distance in the block are
    split by all bits, and then compared within the radius of the boundary.
    """
    forest, every = _Forest(len(points)), np.uint64(2**64 - 1)
    todo = [(np.arange(len(points)), np.uint64(mask), block_radius)]
    while todo:
        own, bits, reach = todo.pop()
        if len(own) <= LEAF:
            _compare(points, own, own, radius, forest)
            continue
        far = np.bitwise_count((points[own] ^ points[own[len(own) // 2]]) & bits).astype(np.int64)
        median = int(np.median(far))
        if median == far.max():
            median -= 1
        if median < far.min():
            todo.append((own, every, radius))  # distinct points differ in some bit, so that these do split
            continue
        if reach:
            _compare(points, own[(far <= median) & (far > median - reach)], own[(far > median) & (far <= median + reach)], radius, forest)
        todo += [(own[far <= median], bits, reach), (own[far > median], bits, reach)]
    return forest.flat()


def links(points: DataFrame, staging: Staging, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``radius`` bits of distinct ``points(point)``.

    Distances of 64-bit fingerprints crowd about 32, so that a ball of radius 2 crosses four of ten
    cuts of one tree over all bits. Two points within the radius differ in at most ``radius // blocks``
    bits of one of ``blocks`` blocks; so there is a tree for each block, over the Hamming distance
    within it and with that smaller radius: by default two trees and a radius of 1. A point goes to each
    leaf that its ball can touch by the triangle inequality, as the leaves are the shards. Each shard
    gives at most an edge for each of its points.
    """
    count = points.count()
    depth = max(0, min(int(np.ceil(np.log2(max(1, count) / SHARD_ROWS))), int(np.log2(SAMPLE)) - 4))
    taken = points.orderBy(F.xxhash64("point")).limit(min(SAMPLE, 64 << depth)).select("point") if depth else None
    sample = (taken.toPandas()["point"].to_numpy(np.int64) if depth else np.zeros(0, np.int64)).view(np.uint64)
    masks, block_radius = _masks(blocks), radius // blocks
    trees = [VantageTree(sample, mask, depth) for mask in masks]

    def route(batches):
        for batch in batches:
            values = batch["point"].to_numpy(np.int64)
            for number, tree in enumerate(trees):
                index, leaf = tree.leaves(values.view(np.uint64), block_radius)
                yield pd.DataFrame({"tree": np.int32(number), "leaf": leaf.astype(np.int32), "point": values[index]})

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(rows["point"].to_numpy(np.int64))
        roots = link_shard(values.view(np.uint64), masks[int(rows["tree"].iloc[0])], radius, block_radius)
        linked = np.flatnonzero(roots != np.arange(len(values)))
        return pd.DataFrame({"a": values[linked], "b": values[roots[linked]]})

    routed = points.select("point").mapInPandas(route, "tree int, leaf int, point long")
    return routed.groupBy("tree", "leaf").applyInPandas(shard, "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs(doc_id, text)``.

    Documents are linked when their fingerprints differ in ``radius`` bits or fewer; component_id is the
    smallest doc_id reachable, itself included, null ids aside (a component of null ids only has
    null). Equal fingerprints are one point, so copies in any number cost one. An empty table gives
    no row; null and empty texts have fingerprint 0, which is linked like any other.
    """
    staging = Staging(docs.sparkSession, "near")
    prints = staging.write(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "fingerprints")
    label = staging.write(_labels(prints, staging, radius, blocks).select("fp", "component_id", "n"), "labels")
    # Rows of frequent fingerprints, which no key may gather in one task, meet their labels where they are.
    least = max(1, prints.count() // FREQUENT)
    often = F.broadcast(label.where(F.col("n") > least).select("fp", "component_id"))
    rest = prints.join(F.broadcast(often.select("fp")), "fp", "left_anti").join(label.where(F.col("n") <= least).drop("n"), "fp")
    return prints.join(often, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def _labels(prints: DataFrame, staging: Staging, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root, component_id, n) for each distinct fp of ``prints(doc_id, fp)``; root is the least fingerprint of its group, n its own rows."""
    points = staging.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumnRenamed("fp", "point"), "points")
    edges = staging.write(links(points, staging, radius, blocks), "links")
    grouped = connected_components(edges, staging)
    named = points.join(grouped, points["point"] == grouped["node"], "left").select(
        "point", "least", "n", F.coalesce("root", "point").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select(F.col("point").alias("fp"), "root", "component_id", "n")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group, with its columns as they are.

    Of a group the row with the smallest doc_id stays (null ids last), of those the one with the smallest
    hash of its text; of rows that share both one stays. Groups are told apart by fingerprints, so rows
    that share an id, or have none, stay in each of their groups.
    """
    staging = Staging(docs.sparkSession, "near")
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    prints = staging.write(
        docs.select("doc_id", fingerprints(F.col("text")).alias("fp"), F.col("text").isNull().alias("blank"), digest.alias("digest")), "fingerprints"
    )
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "blank")).alias("best")
    # The best row of each fingerprint, then of each group: no more rows meet than there are fingerprints.
    least = prints.groupBy("fp").agg(best)
    stays = staging.write(
        least.join(_labels(prints.select("doc_id", "fp"), staging), "fp").groupBy("root").agg(F.min("best").alias("best"))
        .select(F.col("best.doc_id").alias("stay_id"), F.col("best.digest").alias("stay_digest"), F.col("best.blank").alias("stay_blank")),
        "stays",
    )
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    named = named.select("doc", "doc_id", F.col("text").isNull().alias("blank"), digest.alias("digest"))
    met = named.join(
        stays,
        F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest")) & (F.col("blank") == F.col("stay_blank")),
        "left_semi",
    )
    # Only wholly repeated ids and texts let one decision meet several rows.
    key = ["doc_id", "digest", "blank"]
    repeated = prints.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return met.select("doc.*")
    again = repeated.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("blank").alias("r_blank"), F.lit(True).alias("again"))
    flagged = met.join(
        again, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")) & (F.col("blank") == F.col("r_blank")), "left"
    )
    single = flagged.where("again is null").select("doc.*")
    several = flagged.where("again").dropDuplicates(key).select("doc.*")
    return single.unionByName(several)
