"""MinHash near-dedup with odd sketches against all pairs of full sets."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import odd_sketch


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute(rows, percent=85):
    """doc_id -> (n, component) by all pairs of distinct sets; ids are distinct."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def compare(df):
    rows = [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]
    found = odd_sketch.near_duplicates(df).collect()
    order = lambda xs: sorted(xs, key=str)
    assert order((x.doc_id, x.n_shingles, x.component_id) for x in found) == order(brute(rows))
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)


def test_documents(docs):
    compare(docs)


def families(rng, groups, members, words):
    """Groups of edited copies whose similarities lie about the threshold."""
    names = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    out = []
    for _ in range(groups):
        own = ["".join(rng.choice(names, 3)) for _ in range(words)]
        for _ in range(members):
            own = list(own)
            for _ in range(rng.integers(1, 4)):
                own[rng.integers(0, words)] = "".join(rng.choice(names, 3))
            out.append(" ".join(own))
    return out


def test_chains_about_the_threshold(spark):
    texts = families(np.random.default_rng(3), 30, 12, 100)
    data = [(int(i), t) for i, t in zip(np.random.default_rng(4).permutation(len(texts)), texts, strict=True)]
    compare(spark.createDataFrame(data, "doc_id long, text string").repartition(5))


@pytest.mark.parametrize("chunk", [16, 1024])
def test_large_buckets(spark, chunk, monkeypatch):
    monkeypatch.setattr(odd_sketch, "CHUNK", chunk)
    monkeypatch.setattr(odd_sketch, "SMALL", chunk // 4)
    texts = families(np.random.default_rng(5), 2, 150, 90)
    rng = np.random.default_rng(6)
    for text in texts[:120]:  # members of one bucket that are alike without being similar
        words = text.split()
        cut = rng.integers(60, 80)
        texts.append(" ".join(words[:cut] + [f"own{k}{cut}" for k in range(90 - cut)]))
    data = [(k, t) for k, t in enumerate(texts)] + [(10000 + k, texts[0].upper() + "  ") for k in range(400)]
    compare(spark.createDataFrame(data, "doc_id long, text string").repartition(4))


def test_odd_rows(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(200_000))
    data = [(1, None), (2, ""), (3, "\n\t "), (4, "one two"), (5, "ONE\ttwo\n"), (6, "one"), (None, "one"), (None, "other words stand here alone"), (None, None)]
    data += [(7, "a b c d e"), (8, "a b c d e f"), (9, "same words come here again and again"), (9, "same words come here again and again"), (10, long), (11, long + " end")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("digest", "row", "cls", "bands", "key", "n")})
    compare(df)
    assert odd_sketch.near_duplicates(df.limit(0)).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_only_what_may_be_similar_is_shuffled(spark):
    """Sketches and bands of sets that are alone stay where they are, also where no table is small enough to be broadcast."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(3000)]
    texts += [t + " end" for t in texts[:20]] + texts[:10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    assert df.count() == 3030
    name = "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")
        before = shuffled(spark)
        found = odd_sketch.near_duplicates(df).collect()
        own = shuffled(spark) - before
    finally:
        spark.conf.set(name, threshold)
    assert sum(not x.kept for x in found) == 30
    assert own < 800 * len(texts)  # keys of bands are about 420 of them


def test_sketches_estimate_and_let_similar_sets_through():
    rng = np.random.default_rng(7)
    errors, bits = [], []
    for _ in range(300):
        base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        apart = 81  # 919 of 1081 are common: 85 %
        pair = [np.unique(np.concatenate([base[:919], rng.integers(0, 2**63, apart, dtype=np.uint64)])) for _ in range(2)]
        _, sketch = odd_sketch.signatures(pair)
        bits.append(int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum()))
        errors.append(odd_sketch.estimate(bits[-1]) - 0.85)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045 and max(bits) <= odd_sketch.most_bits()


def test_shingles_of_long_texts_do_not_depend_on_segments(monkeypatch):
    text = " ".join(f"word{k % 700}\n" for k in range(40_000))
    whole = odd_sketch.shingle_sets([text])[0]
    monkeypatch.setattr(odd_sketch, "SEGMENT", 5000)
    assert (odd_sketch.shingle_sets([text])[0] == whole).all() and len(whole) == 700
