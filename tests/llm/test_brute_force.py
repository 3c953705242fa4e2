"""Operators 1, 5 and 9 against plain versions, and the bound of the labelled samples."""

import math
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chronoweave.llm import language_id, quality, sharding
from chronoweave.llm.sampling import training_rows

LATIN = "abcdefghijklmnopqrstuvwxyz"


def presence_set(text):
    """Slots of the byte n-grams of 1 to 4 bytes, one at a time."""
    data = [c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()]
    found, at = set(), 0
    for n, bits in ((1, 8), (2, 12), (3, 13), (4, 14)):
        for k in range(len(data) - n + 1):
            gram = sum(b << 8 * i for i, b in enumerate(data[k : k + n]))
            found.add(at + (gram if bits == 8 else gram * 0x9E3779B1 % 2**32 >> 32 - bits))
        at += 1 << bits
    return found


def test_language_scores_are_those_of_kernel_ridge_regression():
    """With every example a landmark the Nystroem features give the whole kernel."""
    rng = np.random.default_rng(1)
    texts, names = [], []
    for k in range(45):
        own = LATIN[(k % 3) * 7 : (k % 3) * 7 + 12] + "é" * (k % 3)
        texts.append(" ".join("".join(rng.choice(list(own), rng.integers(2, 8))) for _ in range(12)) + " 12!")
        names.append("abc"[k % 3])
    asked = [texts[0][:40], texts[4][5:60], "zz yy xx", "x", *texts[:5]]
    sets, other = [presence_set(t) for t in texts], [presence_set(t) for t in asked]
    gram = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    wanted = np.array([[1.0 if n == c else -1.0 for c in "abc"] for n in names])
    alpha = np.linalg.solve(gram + language_id.RIDGE * len(texts) * np.eye(len(texts)), wanted)
    want = np.array([[len(a & b) / math.sqrt(max(1, len(a)) * len(b)) for b in sets] for a in other]) @ alpha
    marks = np.packbits(language_id.presence(texts).astype(np.uint8), axis=1)
    model = language_id.fit(marks, names, landmarks=100)
    assert model.languages == ["a", "b", "c"]
    assert np.allclose(model.scores(asked), want, atol=2e-3)


def walk(rows, shards, virtual):
    """The shard of each row: to the first node clockwise, if its shard has room, else further on; arcs in the order of the ring."""
    nodes = sorted((xxhash.xxh64_intdigest(f"shard-{s}-node-{v}") - 2**63, s) for s in range(shards) for v in range(virtual))
    places, room = [p for p, _ in nodes], [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    arcs = {}
    for place in rows:
        arcs.setdefault(bisect_left(places, place) % len(nodes), []).append(place)
    counts, later = Counter(), []
    for arc, own in sorted(arcs.items()):
        shard = nodes[arc][1]
        taken = min(len(own), room[shard])
        room[shard] -= taken
        counts[arc, shard] += taken
        later.append((arc, len(own) - taken))
    for arc, n in later:
        step = arc
        while n:
            step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            taken = min(n, room[shard])
            room[shard] -= taken
            counts[arc, shard] += taken
            n -= taken
    return counts, places


def test_shards_are_those_of_a_walk_on_the_ring(spark, docs):
    held = docs.select("doc_id", "text").withColumn("place", F.xxhash64(F.col("doc_id").cast("string")))
    rows = held.collect()
    for shards, virtual in ((5, 8), (24, 64)):
        want, places = walk([x.place for x in rows], shards, virtual)
        found = sharding.shard(docs, shards, virtual).collect()
        place_of = {x.doc_id: x.place for x in rows}
        got = Counter((bisect_left(places, place_of[x.doc_id]) % len(places), x.shard) for x in found)
        assert got == Counter({k: n for k, n in want.items() if n})
        assert Counter((x.doc_id, x.size, x.text_crc32, x.law, x.grown_shard) for x in found) == Counter(
            (x.doc_id, len((x.text or "").encode()) + 8, zlib.crc32((x.text or "").encode()), "rows", None) for x in rows
        )
        assert sorted((x.shard, x.slot) for x in found) == [(s, k) for s in range(shards) for k in range(sum(y.shard == s for y in found))]


def test_one_more_shard_moves_few_rows(spark):
    """Rows whose shard changes from 24 to 25, beside the 96 % that a plain remainder moves."""
    docs = spark.range(20_000).selectExpr("id doc_id", "cast(id as string) text")
    a, b = ({x.doc_id: x.shard for x in sharding.shard(docs, n).collect()} for n in (24, 25))
    moved = np.mean([a[k] != b[k] for k in a])
    assert 1 / 25 <= moved < 0.5


def test_quality_weights_are_those_of_a_plain_loop():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words[: 40 if k % 3 else 60], 25)) + (" !! !!" if k % 3 == 0 else "") for k in range(90)]
    labels = [int(k % 3 > 0) for k in range(90)]
    bits = 10
    sample = [(*quality.features(t, bits), y) for t, y in zip(texts, labels, strict=True)]
    alpha, beta, l1, l2, size = 0.5, 1.0, 0.02, 0.1, 1 << bits
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    share = {y: len(texts) / (2 * labels.count(y)) for y in (0, 1)}
    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(sample)):
            slots, values, y = sample[k]
            row = [*zip(slots.tolist(), values.tolist(), strict=True), (size, 1.0)]
            p = 1 / (1 + math.exp(-sum(weight(s) * x for s, x in row)))
            own = {s: weight(s) for s, _ in row}
            for s, x in row:
                g = share[y] * (p - y) * x
                sigma = (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / alpha
                z[s] += g - sigma * own[s]
                n[s] += g * g
    assert np.allclose(quality.fit(sample, bits), [weight(k) for k in range(size + 1)], atol=1e-9)


def test_quality_scores_are_the_sparse_product(spark, docs, labels):
    marks = labels.select("doc_id", F.col("quality").alias("label"))
    weights = quality.train(docs, marks)
    found = quality.quality_scores(docs, marks).collect()
    texts = {x.doc_id: x.text or "" for x in docs.select("doc_id", "text").collect()}
    for x in found:
        slots, values = quality.features(texts[x.doc_id])
        total = sum(v * float(np.float32(weights[s])) for s, v in zip(slots.tolist(), values.tolist(), strict=True)) + float(np.float32(weights[-1]))
        assert math.isclose(x.score, 1 / (1 + math.exp(-total)), abs_tol=1e-5) and x.predicted == int(x.score >= 0.3)
        assert x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 5 == 0)
    one = quality.quality_scores(docs, marks.where("label = 1")).select("score").collect()
    assert len(one) == len(found) and all(0 <= x.score <= 1 for x in one)


def test_a_hot_id_gives_one_row_of_the_sample(spark):
    free = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 5][:2000]
    docs = spark.createDataFrame([(free[0], f"copy {k}") for k in range(2000)] + [(free[0], "same")] * 50 + [(k, f"own {k}") for k in free[1:]], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in free] + [(free[0], 0)] * 30, "doc_id long, label long")
    got = training_rows(docs.repartition(6), marks, 600).collect()
    assert len({x.doc_id for x in got}) == len(got) <= 1200
    every = training_rows(docs.repartition(3), marks, 5000).collect()
    assert len(every) == 2000 and [x.text for x in every if x.doc_id == free[0]] == [x.text for x in training_rows(docs, marks, 5000).collect() if x.doc_id == free[0]]
