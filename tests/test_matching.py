"""Tables of rules, blockwise nearest rows and the segmented index against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from chronoweave.operators import rules
from chronoweave.operators.index import SegmentedIndex
from chronoweave.operators.nearest import nearest_rows
from chronoweave.sources.shared import scratch


@pytest.mark.parametrize("most", [3, 10**6])
def test_substrings(spark, most):
    texts = [(1, "The cat sat on the mat"), (2, "CATALOGUE"), (3, None), (4, ""), (None, "a mat"), (1, "dog")]
    known = [("r1", "cat"), ("r2", "CAT"), ("r3", "the mat"), ("r4", ""), ("r5", None), ("r6", "atalog"), ("r7", "zebra"), ("r1", "mat")]
    items = spark.createDataFrame(texts, "id long, text string").repartition(3)
    found = rules.substring_matches(items, "id", "text", spark.createDataFrame(known, "rule string, pattern string"), most)
    want = Counter((i, r) for i, t in texts if t for r in {r for r, p in known if p and p.lower() in t.lower()})
    assert Counter(map(tuple, found.collect())) == want


def test_addresses(spark):
    pages = [(1, "https://www.Example.com/a/b/?x=1"), (2, "example.com/a"), (3, "http://example.com/ab"), (4, "https://example.com"), (5, "http://other.com/a/b"), (6, None), (7, " "), (8, "ftp://example.com/a/b/c#d")]
    known = [("root", "example.com"), ("a", "http://www.example.com/a/"), ("deep", "example.com/a/b/c"), ("none", ""), ("gone", None)]
    found = rules.url_matches(spark.createDataFrame(pages, "id long, url string"), "id", "url", spark.createDataFrame(known, "rule string, url string"))
    want = {(1, "root"), (1, "a"), (2, "root"), (2, "a"), (3, "root"), (4, "root"), (8, "root"), (8, "a"), (8, "deep")}
    assert Counter(map(tuple, found.collect())) == Counter(want)


def test_redaction(spark):
    items = spark.createDataFrame([(1, "bank", "balance"), (2, "notes", "my Secret plan"), (3, "notes", "shopping"), (4, None, None)], "id long, name string, text string")
    known = spark.createDataFrame([("n", "name", "BANK"), ("t", "text", "secret")], "rule string, kind string, pattern string")
    assert {x.id: x.text for x in rules.redacted(items, "id", "name", "text", known).collect()} == {1: "", 2: "", 3: "shopping", 4: None}
    assert rules.redacted(items, "id", "name", "text", known.limit(0)).where("text = ''").count() == 0


@pytest.mark.parametrize("block", [3, 100])
def test_nearest_rows(spark, block):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(80, 6))
    vectors[7], vectors[9] = vectors[5], 0
    data = [(k, k % 4, v.tolist()) for k, v in enumerate(vectors)] + [(None, 1, [1.0] * 6), (99, 2, None)]
    rows = spark.createDataFrame(data, "id long, label long, v array<double>").repartition(4)
    asked = rows.where("id % 10 = 0").selectExpr("id query_id", "v q")
    allowed = spark.createDataFrame([(q, g) for q in range(0, 80, 10) for g in (q % 4, 3)], "query_id long, group long")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for group, among in ((None, lambda q, k: True), ("label", lambda q, k: k % 4 in (q % 4, 3))):
        found = nearest_rows(rows, asked, "id", "v", 5, group, allowed if group else None, block)
        got = {}
        for x in found.collect():
            got.setdefault(x.query_id, {})[x.place] = x.item
        for q in range(0, 80, 10):
            order = sorted((k for k in range(80) if k != 9 and among(q, k)), key=lambda k: (-round(float(unit[q] @ unit[k]), 6), k))[:5]
            assert [got[q][p] for p in range(1, 6)] == order


def brute(docs, terms):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs.items()}
    mean, scores = sum(map(len, words.values())) / len(words), {}
    for term in terms:
        n = sum(term in w for w in words.values())
        idf = max(math.log((len(words) - n + 0.5) / (n + 0.5)), 0) or 1e-6
        for i, w in words.items():
            if f := w.count(term):
                scores[i] = scores.get(i, 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return {i: round(s, 9) for i, s in scores.items()}


def test_index_after_changes_equals_a_rebuild(spark):
    rng = np.random.default_rng(2)
    names = ["alpha", "beta", "gamma", "delta", "common"]
    text = lambda: " ".join(rng.choice(names, rng.integers(1, 9), p=[0.1, 0.1, 0.1, 0.1, 0.6]))
    frame = lambda held: spark.createDataFrame(list(held.items()), "doc_id long, text string")
    index, docs = SegmentedIndex(spark, scratch(spark, "test-index"), buckets=8), {}
    for turn in range(3):
        new = {turn * 100 + k: text() for k in range(40)} | ({999: None, 998: ""} if turn == 0 else {})
        index.insert(frame(new))
        docs |= new
        changed = {int(k): text() for k in rng.choice(sorted(docs), 9, replace=False)}
        index.update(frame(changed))
        docs |= changed
        gone = [int(k) for k in rng.choice(sorted(docs), 7, replace=False)]
        index.delete(spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        docs = {k: t for k, t in docs.items() if k not in gone}
        if turn == 1:
            index.merge()
            assert len(index.segments) == 1
        again = SegmentedIndex.open(spark, index.path)
        assert again.segments == index.segments
        for asked in (["alpha", "common"], ["beta"], ["nothing"]):
            assert {x.doc_id: round(x.score, 9) for x in again.search(asked).collect()} == brute(docs, asked)
    plan = index.postings(["alpha"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_a_change_that_failed_leaves_no_trace(spark):
    index = SegmentedIndex(spark, scratch(spark, "test-index"), buckets=4)
    index.insert(spark.createDataFrame([(1, "one two"), (2, "two")], "doc_id long, text string"))
    bad = spark.createDataFrame([(3, "two three")], "doc_id long, text string").selectExpr("doc_id", "if(doc_id = 3, raise_error('lost'), text) text")
    with pytest.raises(Exception, match="lost"):
        index.insert(bad)
    again = SegmentedIndex.open(spark, index.path)
    assert {x.term: x.df for x in again.terms().collect()} == {"one": 1, "two": 2}
    again.insert(spark.createDataFrame([(3, "two three")], "doc_id long, text string"))
    assert {x.term: x.df for x in again.terms().collect()} == {"one": 1, "two": 3, "three": 1}


def test_nearest_rows_compare_few_rows_at_once(spark, monkeypatch):
    """Batches of any size: what a task holds of cosines is bounded, also with groups and ties."""
    from chronoweave.operators import nearest

    assert nearest.BLOCK * nearest.ROWS * 8 <= 16_000_000
    monkeypatch.setattr(nearest, "ROWS", 7)
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = spark.createDataFrame([(k, v.tolist(), k % 3 if k % 5 else None) for k, v in enumerate(vectors)], "id long, v array<double>, g long").repartition(3)
    asked = rows.where("id % 20 = 0").selectExpr("id query_id", "v q")
    allowed = asked.selectExpr("query_id", "query_id % 3 as group")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for limit in (None, allowed):
        found = {(x.query_id, x.place): x["item"] for x in nearest.nearest_rows(rows, asked, "id", "v", 6, "g" if limit is not None else None, limit, block=4).collect()}
        want = {}
        for q in range(0, 300, 20):
            cos = np.round(unit @ unit[q], 6)
            own = [k for k in range(300) if vectors[k].any() and (limit is None or (k % 5 and k % 3 == q % 3))]
            want |= {(q, n + 1): k for n, k in enumerate(sorted(own, key=lambda k: (-cos[k], k))[:6])}
        assert found == want


def test_batches_of_long_rows_are_bounded(spark):
    from chronoweave.queries import QUERIES

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for query, most in (("fn_hash_embed", 512), ("fn_unified_diff", 512)):
            spark.conf.set(name, "10000")
            QUERIES[query](spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get(name)) <= most
    finally:
        spark.conf.set(name, before)


def test_an_insert_shuffles_each_posting_once(spark):
    """Words are those of ``functions.text.words``, also in odd texts; they are counted where their rows are."""
    from pyspark.sql import functions as F

    from chronoweave.functions.text import words

    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    odd = ["İstanbul ΣΑΣ Σ naïvé x² WE’LL", "a_b __ c-d ½Ⅷ١ 漢字あ กิน", "Straße STRASSE ǅ ﬁn ªº ① \U0001d7d8 \U00010400", "", None, " ... ", "one " * 3000]
    odd.append("".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000 and chr(c).isprintable()))
    odd.append("".join(map(chr, [*range(1, 0x250), *range(0x2010, 0x2028), 0x20AC])))  # cut by Python
    df = spark.createDataFrame(list(enumerate(odd + [f"w{k} w{k % 7} w{k % 7}" for k in range(300)])), "doc_id long, text string").repartition(4).cache()
    want = {(x.doc_id, x.term): x["count"] for x in df.select("doc_id", F.explode(words(F.col("text"))).alias("term")).groupBy("doc_id", "term").count().collect()}
    sizes = {x.doc_id: max(x.n or 0, 0) for x in df.select("doc_id", F.size(words(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    index = SegmentedIndex(spark, scratch(spark, "test-index"), buckets=8)
    index.insert(df.limit(0))  # what is asked once
    before = shuffled()
    index.insert(df)
    assert shuffled() - before == len(want)
    assert {(x.doc_id, x.term): x.tf for x in index.postings().collect()} == want
    assert {x.doc_id: x.len for x in index.lengths().collect()} == sizes
