"""MinHash near-dedup with odd sketches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.bytehash import SEGMENT, mix, segments, word_hashes
from chronoweave.llm.components import connected_components
from chronoweave.llm.idfilter import IdFilter
from chronoweave.llm.staging import Staging

WORDS = 5
#: Documents are linked whose sets have at least this percentage of their union in common.
PERCENT = 85
BANDS = 32
ROWS = 6
SKETCH_BITS = 512
#: A pair at the threshold is let through unless its sketches lie so many standard deviations off.
DEVIATIONS = 5
#: Members of a bucket that are compared in one piece.
CHUNK = 1024
#: Turns of hubs, as long as buckets of over SMALL members are in several components.
HUBS = 3
SMALL = 64
#: A class with more than this part of all rows is frequent; so no more than so many are.
FREQUENT = 1000
#: Ids and pairs that meet full sets are broadcast up to so many rows (of under 64 bytes); beyond, the sets are shuffled to them.
BROADCAST = 200_000
_SAMPLES = BANDS * ROWS
_SEEDS = mix(mix(np.arange(1, 2 * _SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
_FLIPS, _TIMES = _SEEDS[:_SAMPLES], _SEEDS[_SAMPLES:] | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` after A-Z became lower case. With fewer words than a shingle the
    whole sequence is one; a text without words has none.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    held, size = [], 0

    def settle() -> None:
        if held:
            hashes, first = word_hashes(b"\n".join(x for _, x in held))
            for (k, _), own in zip(held, _shingles(hashes, first, words), strict=True):
                out[k] = own

    for k, text in enumerate(texts):
        data = (text or "").encode().lower()
        if len(data) > SEGMENT:
            parts = [b" ".join(piece.split()) for piece in segments(data)]
            hashes = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(x)[0] for x in parts if x)])
            if len(hashes):
                out[k] = _shingles(hashes, np.zeros(1, np.int64), words)[0]
        elif plain := b" ".join(data.split()):
            held.append((k, plain))
            size += len(plain)
            if size >= SEGMENT:
                settle()
                held, size = [], 0
    settle()
    return out


def _shingles(hashes: np.ndarray, first: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the shingles of each text, whose words begin at ``first``."""
    counts = np.diff(np.append(first, len(hashes)))
    at = np.arange(len(hashes)) - np.repeat(first, counts)
    left = np.repeat(counts, counts) - at
    after = np.append(hashes, np.zeros(words - 1, np.uint64))
    joined = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        joined = mix(joined + np.where(left > k, after[k : k + len(hashes)] * np.uint64(2 * k + 3), np.uint64(k)))
    whole = (left >= words) | (at == 0)
    ends = np.cumsum(np.maximum(counts - words + 1, 1))
    return [np.unique(x) for x in np.split(joined[whole], ends[:-1])]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketches), both signed, of sets that are not empty.

    A sample is the least value of a set by one of the orders. A band's key is a hash of its number and its
    ROWS samples. The odd sketch holds the parity of how many samples, each with its number, hash to each of SKETCH_BITS bits.
    """
    values = np.concatenate(sets)
    starts = np.append(0, np.cumsum([len(x) for x in sets])[:-1])
    least = np.empty((_SAMPLES, len(sets)), np.uint64)
    for k in range(_SAMPLES):
        least[k] = np.minimum.reduceat((values ^ _FLIPS[k]) * _TIMES[k], starts)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[k])
        keys[:, band] = key
    spots = mix(mix(least + _SEEDS[:_SAMPLES, None])) % np.uint64(SKETCH_BITS)
    flat = (spots.astype(np.int64) + np.arange(len(sets)) * SKETCH_BITS).ravel()
    odd = np.bincount(flat, minlength=len(sets) * SKETCH_BITS).reshape(len(sets), SKETCH_BITS) & 1
    return keys.view(np.int64), np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def estimate(differing_bits: np.ndarray | float) -> np.ndarray | float:
    """The similarity of two sets whose sketches differ in so many bits."""
    share = np.minimum(2 * np.asarray(differing_bits) / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * _SAMPLES) * np.log(1 - share)


def most_bits(percent: int = PERCENT, deviations: float = DEVIATIONS) -> int:
    """The differing bits beyond which two sketches show that a pair lies below the threshold."""
    apart = 1 - percent / 100
    samples = _SAMPLES * apart + deviations * np.sqrt(_SAMPLES * apart * (1 - apart))
    return int(np.ceil(SKETCH_BITS * (1 - np.exp(-4 * samples / SKETCH_BITS)) / 2))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch, shingles) for each row of ``docs(doc_id, text)``.

    digest is the MD5 of the sorted set; an empty set has null for it and empty arrays.
    """

    def lists(rows: list[np.ndarray]) -> pa.ListArray:
        ends = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in rows)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch["text"].to_pylist())
            full = [k for k, x in enumerate(sets) if len(x)]
            bands, sketches = [np.zeros(0, np.int64)] * len(sets), [np.zeros(0, np.int64)] * len(sets)
            for start in range(0, len(full), 64):
                some = full[start : start + 64]
                for k, own, odd in zip(some, *signatures([sets[k] for k in some]), strict=True):
                    bands[k], sketches[k] = own, odd
            digests = [hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets]
            columns = [batch["doc_id"], pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), lists(bands), lists(sketches), lists(sets)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands", "sketch", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        made, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>, sketch array<long>, shingles array<long>"
    )


def differing_bits(a: Column, b: Column) -> Column:
    """How many bits two sketches differ in."""
    out = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        out = out + F.bit_count(a[k].bitwiseXOR(b[k]))
    return out


def _small(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` of known number, to be broadcast if they are few."""
    return F.broadcast(rows) if count <= BROADCAST else rows


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, staging: Staging, name: str, percent: int) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` that are similar, as a staged table: the sketches are looked at first, then the full sets.

    Only sketches of the pairs, and sets of those that pass the sketches, are shuffled.
    """
    pairs = staging.write(pairs, f"pairs-{name}")
    wanted = IdFilter(pairs.select(F.explode(F.array("a", "b")).alias("cls")), 2 * pairs.count())
    small = classes.where(wanted.may_have(F.col("cls"))).select("cls", "n_shingles", "sketch")
    left = [F.col("cls").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a")]
    right = [F.col("cls").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b")]
    met = pairs.join(small.select(*right), "b").join(small.select(*left), "a")
    near = staging.write(
        met.where(
            (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differing_bits(F.col("s_a"), F.col("s_b")) <= most_bits(percent))
        ).select("a", "b", "n_a", "n_b"),
        f"near-{name}",
    )
    count = near.count()
    sides = [sets.where(IdFilter(near.select(side), count).may_have(F.col("cls"))).select(F.col("cls").alias(side), F.col("shingles").alias(f"x_{side}")) for side in ("b", "a")]
    both = F.size(F.array_intersect("x_a", "x_b"))
    full = sides[0].join(_small(near, count), "b").join(sides[1], "a").where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))
    return staging.write(full.select("a", "b"), f"links-{name}")


_ROW = ["key", "piece", "side", "cls", "component"]


def _candidates(rows: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of the members of a bucket's piece that may be similar: in different components, with near sketches.

    A pair is looked at in one bucket only, that of the least key it shares. side tells what a member is compared
    with: 0 with every other, 1 only with those of side 2.
    """
    first, second = np.flatnonzero(rows["side"] != 2), np.flatnonzero(rows["side"] != 1)
    group, n, sketch, bands, key = (rows[c] for c in ("component", "n_shingles", "sketch", "bands", "key"))
    out = [(np.zeros(0, np.int64),) * 3]
    for start in range(0, len(first), 64):
        own = first[start : start + 64]
        good = (group[own, None] != group[second]) & (100 * np.minimum(n[own, None], n[second]) >= percent * np.maximum(n[own, None], n[second]))
        i, j = np.nonzero(good)
        i, j = own[i], second[j]
        for k in range(0, len(i), 1 << 15):
            x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            bits = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1).astype(np.int64)
            x, y, bits = (v[bits <= most_bits(percent)] for v in (x, y, bits))
            least = np.where(bands[x] == bands[y], bands[x], np.iinfo(np.int64).max).min(axis=1)
            out.append(tuple(v[least == key[0]] for v in (x, y, bits)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_piece(batches: Iterator[pa.RecordBatch], lists: dict[str, int]) -> Iterator[dict]:
    """The rows of each piece of a bucket, of rows sorted by it; ``lists`` has the lengths of array columns, 0 where they differ."""

    def read(batch: pa.RecordBatch) -> dict:
        rows = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in lists}
        for c, width in lists.items():
            if width:
                rows[c] = np.asarray(batch[c].flatten()).reshape(-1, width)
            else:
                rows[c] = np.empty(batch.num_rows, object)
                rows[c][:] = [np.asarray(x.values).view(np.uint64) for x in batch[c]]
        rows["sketch"] = rows["sketch"].view(np.uint64)
        return rows

    held: dict | None = None
    for batch in batches:
        rows = read(batch)
        held = rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in rows}
        new = np.flatnonzero((held["key"][1:] != held["key"][:-1]) | (held["piece"][1:] != held["piece"][:-1])) + 1
        bounds = [0, *new.tolist()]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s > 1:
                yield {c: x[s:e] for c, x in held.items()}
        held = {c: x[bounds[-1] :] for c, x in held.items()}
    if held is not None and len(held["key"]) > 1:
        yield held


_LISTS = {"sketch": SKETCH_BITS // 64, "bands": BANDS}


def _active(percent: int):
    """Those members of a piece that have a candidate in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_piece(batches, _LISTS):
            i, j, _ = _candidates(rows, percent)
            if len(i):
                own = np.union1d(i, j)
                yield pa.RecordBatch.from_arrays([pa.array(rows[c][own]) for c in _ROW], names=_ROW)

    return run


def _confirmed(percent: int):
    """Edges of similar candidates, nearest sketches first, without those that earlier ones of the piece make needless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_piece(batches, _LISTS | {"shingles": 0}):
            i, j, bits = _candidates(rows, percent)
            root, edges = {}, []

            def top(x: int, root=root) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            sets, group, cls = rows["shingles"], rows["component"], rows["cls"]
            for k in np.argsort(bits, kind="stable").tolist():
                x, y = i[k], j[k]
                if top(int(group[x])) == top(int(group[y])):
                    continue
                small, large = sorted((sets[x], sets[y]), key=len)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= percent * (len(small) + len(large) - both):
                    root[top(int(group[x]))] = top(int(group[y]))
                    edges.append((int(cls[x]), int(cls[y])))
            if edges:
                yield _frame(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))

    return run


def _frame(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _named(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members(key, cls)`` of those buckets whose members lie in several components of ``edges``, with their component and the bucket's size."""
    grouped = connected_components(edges, Staging(members.sparkSession, "odd-components"))
    named = members.join(grouped, members["cls"] == grouped["node"], "left").select("key", "cls", F.coalesce("root", "cls").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other"), F.count("*").alias("size")).where("one < other")
    return named.join(several.select("key", "size"), "key")


def links(classes: DataFrame, sets: DataFrame, staging: Staging, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) that connect what pairs of similar sets connect, of ``classes(cls, n_shingles, bands, sketch)``; ``sets`` has the same columns and shingles.

    Sets meet in the buckets of equal band keys: at 85 % one of 32 bands of six samples agrees with a
    probability of 1 - 3e-7. First each set is compared with one hub, the least member of its largest
    bucket. While buckets of over SMALL members lie in several components of these links, some more turns
    follow, with other hubs and for members of other components than their hub. Then the pairs of members of different
    components are compared in each bucket where their odd sketches are near; in one of over CHUNK
    members only those outside its largest component are compared with the others, a chunk at
    a time. All comparisons end with the full sets.
    """
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    # Most keys are alone; those of buckets are told apart before the join shuffles them.
    buckets = staging.write(keyed.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    some = keyed.where(IdFilter(buckets.select("key"), buckets.count()).may_have(F.col("key")))
    members = staging.write(some.join(buckets, "key"), "members")

    def stars(rows: DataFrame) -> DataFrame:
        """(a, b) for each member and the hub of its largest bucket."""
        largest = F.max(F.struct("size", "key", "hub")).alias("largest")
        return rows.groupBy("cls").agg(largest).select(F.col("largest.hub").alias("a"), F.col("cls").alias("b")).distinct()

    edges = verified(stars(members.where("cls != hub")), classes, sets, staging, "0", percent)
    several = staging.write(_named(members.select("key", "cls"), edges), "several-0")
    for turn in range(1, HUBS):
        large = several.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        hubs = large.groupBy("key").agg(F.min_by(F.struct("cls", "component"), F.xxhash64("cls", F.lit(turn))).alias("other"))
        apart = large.join(hubs, "key").where("component != other.component").select("key", "cls", "size", F.col("other.cls").alias("hub"))
        edges = edges.unionByName(verified(stars(apart), classes, sets, staging, str(turn), percent))
        several = staging.write(_named(members.select("key", "cls"), edges), f"several-{turn}")
    small = several.where(F.col("size") <= CHUNK).select("key", "cls", "component", F.lit(0).alias("piece"), F.lit(0).alias("side"))
    large = several.where(F.col("size") > CHUNK)
    pieces = small if large.isEmpty() else small.unionByName(_large_pieces(large))
    # Most classes are in no bucket of several components; their bands and sketches are told apart before they are shuffled.
    apart = IdFilter(several.select("cls").distinct(), several.count())
    described = pieces.join(classes.where(apart.may_have(F.col("cls"))).select("cls", "n_shingles", "sketch", "bands"), "cls")
    with staging.batches(4096):
        active = staging.write(
            described.repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(_active(percent), "key long, piece int, side int, cls long, component long"), "active"
        )
    count = active.count()
    some = sets.where(IdFilter(active.select("cls").distinct(), count).may_have(F.col("cls")))
    whole = some.join(_small(active, count), "cls").select(*_ROW, "n_shingles", "sketch", "bands", "shingles")
    rest = whole.repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(_confirmed(percent), "a long, b long")
    return edges.unionByName(staging.write(rest, "links-rest"))


def _large_pieces(large: DataFrame) -> DataFrame:
    """The pieces of buckets of over CHUNK members: chunks of the members outside the largest component, each with every chunk of the bucket."""
    counts = large.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("size"), F.max("n").alias("most"))
    told = large.drop("size").join(largest, "key").withColumns({
        "row_chunks": F.ceil((F.col("size") - F.col("most")) / CHUNK), "all_chunks": F.ceil(F.col("size") / CHUNK),
    })
    mixed = F.xxhash64("cls", F.lit("chunk"))
    piece = lambda row, column: (row * F.col("all_chunks") + column).cast("int").alias("piece")
    rest = told.where("component != largest").select(
        "key", "cls", "component", "all_chunks", F.pmod(mixed, "row_chunks").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_chunks") - 1)).alias("column")
    ).select("key", "cls", "component", piece(F.col("row"), F.col("column")), F.lit(1).alias("side"))
    every = told.select(
        "key", "cls", "component", "all_chunks", F.pmod(mixed, "all_chunks").alias("column"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_chunks") - 1)).alias("row")
    ).select("key", "cls", "component", piece(F.col("row"), F.col("column")), F.lit(2).alias("side"))
    return rest.unionByName(every)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of shingles of five words;
    component_id is the smallest doc_id reachable, itself included, null ids aside (a
    component of null ids only has null). kept tells whether it is the row's own id, so that rows that share
    that id are all kept. Equal sets are one class, and cost one. Texts without words, and nulls, are linked
    with nothing, also not with each other. An empty table gives no row.
    """
    staging = Staging(docs.sparkSession, "odd")
    rows = staging.write(features(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    classes = staging.write(
        rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("cls"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes"
    )
    # The row of a set that occurs once is its class; only rows whose set may repeat are shuffled to find that of the class.
    again = classes.where("n > 1")
    repeats = IdFilter(again.select("digest"), again.count()).may_have(F.col("digest"))
    full = rows.where("digest is not null").select("row", "digest", "n_shingles", "bands", "sketch")
    alone = full.where(~repeats).select(F.col("row").alias("cls"), "n_shingles", "bands", "sketch")
    ids = classes.where(repeats).select("cls")
    first = full.where(repeats).join(ids, F.col("row") == F.col("cls")).select("cls", "n_shingles", "bands", "sketch")
    light = staging.write(alone.unionByName(first), "signatures")
    sets = rows.select(F.col("row").alias("cls"), "n_shingles", "sketch", "bands", "shingles")
    grouped = connected_components(links(light, sets, staging, percent), staging)
    named = classes.join(grouped, classes["cls"] == grouped["node"], "left").select("digest", "least", "n", F.coalesce("root", "cls").alias("root"), F.col("root").isNotNull().alias("linked"))
    told = named.where("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.where("linked").join(told, "root").select("digest", "n", "component_id").unionByName(
        named.where("not linked and n > 1").select("digest", "n", F.col("least").alias("component_id"))
    )
    labels = staging.write(labels.withColumn("found", F.lit(True)), "labels")
    # Rows of frequent classes, which no key may gather in one task, meet their labels where they are.
    own, least = rows.select("doc_id", "n_shingles", "digest"), max(1, rows.count() // FREQUENT)
    often = F.broadcast(labels.where(F.col("n") > least).drop("n"))
    seldom = labels.where(F.col("n") <= least).drop("n")
    done = own.join(often, "digest")
    rest = own.join(F.broadcast(labels.where(F.col("n") > least).select("digest")), "digest", "left_anti").join(seldom, "digest", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    out = done.unionByName(rest).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

