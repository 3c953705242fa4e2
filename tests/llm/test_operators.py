"""Each operator against brute force, on the small documents with odd rows among them, and on an empty table."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoweave.llm import ann, bpe, exact_dedup, language_id, line_dedup, near_dedup, packing, quality, sharding, toxicity
from chronoweave.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def rows(docs):
    return [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]


def key(doc_id):
    return -1 if doc_id is None else doc_id


def test_exact(docs, rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, key(doc_id)))
    found = exact_dedup.decide(docs, counters=4, heavy=2).collect()
    assert len(found) == len(rows)
    for x in found:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).digest() == bytes(x.digest))
        assert (x.group_size, key(x.keep_id)) == (len(own), min(own)[2])
    assert sum(x.kept for x in found) == len(groups)
    assert exact_dedup.keep_one(docs).count() == len(groups)


def test_near(docs, rows):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    found = near_dedup.near_groups(docs).collect()
    assert len(found) == len(rows)
    prints = {key(i): brute(t) for i, t in rows if len(t or "") < 20000}
    assert all(prints.get(key(x.doc_id), x.fp % 2**64) == x.fp % 2**64 for x in found)
    points = sorted({x.fp % 2**64 for x in found})
    root = {p: p for p in points}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, p in enumerate(points):
        for q in points[k + 1 :]:
            if (p ^ q).bit_count() <= 2:
                root[top(p)] = top(q)
    smallest = {}
    for x in found:
        group = top(x.fp % 2**64)
        smallest[group] = min(smallest.get(group, 2**63), 2**63 if x.doc_id is None else x.doc_id)
    # The smallest id of the group, and so another one than that of any row it is not linked to.
    assert all(x.component_id == smallest[top(x.fp % 2**64)] for x in found if smallest[top(x.fp % 2**64)] < 2**63)


def test_near_dedup_links_within_two_bits_only(spark, monkeypatch):
    base = " ".join(f"word{k}" for k in range(300))
    rng = np.random.default_rng(2)
    texts = [base, base, base + " one", base.replace("word150", "other"), *(" ".join(rng.choice(base.split(), 60)) for _ in range(300)), None, "", " "]
    docs = spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)] + [(None, base)] * 500, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near_dedup, "SHARD_ROWS", 16)
    for blocks in (1, 2, 3):
        got = {x.doc_id: x for x in near_dedup.near_groups(docs, blocks=blocks).collect()}
        assert docs.count() == 807 and got[100].component_id == got[101].component_id == got[None].component_id == 100
        assert got[404].component_id == got[405].component_id == got[406].component_id and got[404].fp == 0
        want = {}
        for i, x in got.items():
            near = [j for j, y in got.items() if j is not None and (x.fp % 2**64 ^ y.fp % 2**64).bit_count() <= 2]
            want[i] = min(near)
        for i, x in got.items():
            assert x.component_id == want[x.component_id] and x.component_id <= want[i]
            assert x.component_id == want[i] or len({want[j] for j, y in got.items() if y.component_id == x.component_id}) > 1


def test_near_keeps_one_of_each_group_by_text(spark):
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(words, 40)) for _ in range(9)]
    data = [(None, t) for t in texts[:4]] + [(None, texts[0]), (None, texts[0].upper()), (5, texts[4]), (5, texts[5]), (5, texts[5]), (6, texts[5])]
    data += [(7, texts[6]), (None, texts[6]), (8, texts[7]), (None, None), (None, ""), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("other", F.lit(1)).repartition(3)
    kept = [(x.doc_id, (x.text or "").lower()) for x in near_dedup.keep_one_of_each(df).collect()]
    want = [(None, t) for t in texts[:4]] + [(5, texts[4]), (5, texts[5]), (7, texts[6]), (8, texts[7]), (None, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("blocks", [1, 2, 3])
@pytest.mark.parametrize("equal_in_a_block", [False, True])
def test_vantage_trees(blocks, equal_in_a_block):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    if equal_in_a_block:
        base &= ~np.uint64(near_dedup._masks(blocks)[0]) if blocks > 1 else ~np.uint64(2**32 - 1)
        base = np.concatenate([base, base[:600] ^ (np.uint64(1) << rng.integers(40, 60, 600).astype(np.uint64))])
    points = np.unique(np.concatenate([base, base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), base[:80] ^ np.uint64(3)]))
    radius, linked = 2 // blocks, set()
    for mask in near_dedup._masks(blocks):
        index, leaf = near_dedup.VantageTree(rng.permutation(points)[:200], mask, 3).leaves(points, radius)
        for number in range(8):
            own = index[leaf == number]
            roots = near_dedup.link_shard(points[own], mask, 2, radius)
            linked |= {(int(own[i]), int(own[r])) for i, r in enumerate(roots) if i != r}
    forest = near_dedup._Forest(len(points))
    for a, b in linked:
        forest.link(np.array([a]), np.array([b]))
    want = near_dedup._Forest(len(points))
    near_dedup._compare(points, np.arange(len(points)), np.arange(len(points)), 2, want)
    assert (forest.flat() == want.flat()).all()


def test_bpe(docs, rows):
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {key(i): np.array(known.encode_ordinary(t or ""), np.uint32).tobytes() for i, t in rows}
    found = bpe.encoded(docs, path, public_tokenizers.PATTERN).collect()
    assert len(found) == len(rows)
    texts = {key(i): t or "" for i, t in rows}
    assert all(bytes(x.ids) == want[key(x.doc_id)] and bytes(x.decoded).decode() == texts[key(x.doc_id)] for x in found)


def test_bpe_of_long_words():
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    ours = bpe.DuckBpe(path, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rng = np.random.default_rng(5)
    texts = ["A" * 9000, "".join(rng.choice(list("漢字仮名交文"), 2500)), " ".join("".join(rng.choice(list("abcdeé"), 900)) for _ in range(30))]
    ids = ours.encode(texts)
    assert ids == [np.array(known.encode_ordinary(t), np.uint32).tobytes() for t in texts]
    assert ours.decode(ids) == [t.encode() for t in texts]


def test_bpe_of_a_long_text(rows):
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    ours = bpe.DuckBpe(path, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    some = "".join(t for _, t in rows if t)
    long = (some * (50_000_000 // len(some) + 1))[:50_000_000]
    texts = [some, long, "", "end"]
    ids = ours.encode(texts)
    assert [len(x) for x in ids][1] > 8 * bpe._IDS_A_QUERY
    assert ids[0] == np.array(known.encode_ordinary(some), np.uint32).tobytes() and ids[3] == np.array(known.encode_ordinary("end"), np.uint32).tobytes()
    assert ids[1] == np.array(known.encode_ordinary(long), np.uint32).tobytes()
    assert ours.decode(ids) == [t.encode() for t in texts]


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    found = packing.pack(docs, path, length=512).collect()
    places = sorted((x.sequence_id * 512 + x.offset, x.length) for x in found)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0
    want = {key(i): np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], np.uint32) for i, t in rows}
    assert sum(n for _, n in places) == sum(len(want[key(i)]) for i, _ in rows)
    assert all(zlib.crc32(want[key(x.doc_id)][x.start : x.start + x.length].tobytes()) == x.ids_crc32 for x in found)


@pytest.mark.parametrize("special", [True, False])
def test_words_are_encoded_as_the_library_does(rows, special, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = not special
    texts = [t or "" for _, t in rows] + [f"{chr(c)}a{chr(c)}B {chr(c)}1" for c in range(0x250)]
    for chars in (packing.CHUNK_CHARS, 300):  # with the smaller, texts are cut at blanks
        monkeypatch.setattr(packing, "CHUNK_CHARS", chars)
        ids, counts = packing.WordEncoder(path, special, remembered=500).encode(texts)
        want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [len(x) for x in packing.WordEncoder(path).encode([])] == [0, 0]


def test_sharding(docs, rows):
    found = sharding.shard(docs, shards=5, virtual_nodes=8).collect()
    assert len(found) == len(rows)
    slots = {s: sorted(x.slot for x in found if x.shard == s) for s in range(5)}
    assert all(own == list(range(len(own))) for own in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_lines(docs):
    done = {key(x.doc_id): x for x in line_dedup.dedup_lines(docs).collect()}
    assert done[90001].text is None and (done[90007].lines, done[90007].dropped) == (3, 1)
    assert done[90007].text == "one  Two\nthree"
    assert line_dedup.edit_distance("kitten", "sitting") == 3


def test_classifiers(docs, labels, rows):
    scored = quality.quality_scores(docs, labels.select("doc_id", F.col("quality").alias("label"))).collect()
    assert len(scored) == len(rows) and all(0 <= x.score <= 1 for x in scored)
    toxic = toxicity.toxicity(docs, labels.select("doc_id", F.col("toxic").alias("label"))).collect()
    assert len(toxic) == len(rows) and all(0 <= x.score <= 1 for x in toxic)
    found = {key(x.doc_id): x for x in language_id.languages(docs).collect()}
    assert [found[i].lang_pred for i in (90001, 90002, 90003, 90004)] == ["und"] * 4
    known = {x.doc_id: x.lang for x in docs.where("doc_id < 90000").select("doc_id", "lang").collect()}
    held = [i for i in known if found[i].held_out]
    assert np.mean([found[i].lang_pred == known[i] for i in held]) >= 0.95


def test_block_max_is_exact():
    texts = [f"alpha{k % 7} beta{k % 5} gamma{k % 3} {'bad' if k % 4 == 0 else 'good'} word{k}" for k in range(300)]
    terms = [np.unique(toxicity.all_terms(t), return_counts=True) for t in texts]
    index = toxicity.build(list(range(300)), np.array([k % 4 == 0 for k in range(300)], int), terms, np.array([225.0, 75.0]))
    vectors = [index.vector(texts[i]) for i in index.ids]
    dense = np.zeros((len(vectors), len(index.terms)))
    for row, (numbers, weights) in zip(dense, vectors, strict=True):
        row[numbers] = weights
    for numbers, weights in vectors[:40]:
        found, cosines = index.nearest(numbers, weights, 10)
        q = np.zeros(len(index.terms))
        q[numbers] = weights
        assert np.allclose(cosines, np.sort(dense @ q)[::-1][:10])


def test_toxicity_counts_all_terms(spark):
    texts = [f"shared plain{k} line{k % 3} of{k % 4}" for k in range(20)]
    terms = [np.unique(toxicity.all_terms(t), return_counts=True) for t in texts]
    labels = np.array([k % 2 for k in range(20)])
    names = toxicity.vocabulary(terms)
    every = [*texts, *texts[:7], "shared and new", None, ""]
    docs = spark.createDataFrame([(t,) for t in every], "text string").repartition(4)
    frequencies, documents = toxicity.document_frequencies(docs, names)
    sets = [set(toxicity.all_terms(t or "").tolist()) for t in every]
    assert documents == len(every) and frequencies.tolist() == [sum(int(n) in s for s in sets) for n in names]
    index = toxicity.build(list(range(20)), labels, terms, np.array([10.0, 10.0]), frequencies, documents)
    assert len(index.terms) == len(names) and sorted(index.ids) == list(range(20))
    for k, text in enumerate(texts):
        found, cosines = index.nearest(*index.vector(text))
        assert index.ids[found[0]] == k and np.isclose(cosines[0], 1) and cosines[1] < 0.99
    assert index.nearest(*index.vector("shared but everything else unknown"))[1].max() < 0.5


def test_toxicity_is_the_calibrated_vote_of_the_nearest(spark):
    rng = np.random.default_rng(8)
    plain, bad = [f"w{k}" for k in range(400)], ["vile", "rotten", "scum"]
    words = [list(rng.choice(plain, 30)) + (list(rng.choice(bad, 2)) if k % 4 == 0 else []) for k in range(600)]
    texts, labels = [" ".join(rng.permutation(w)) for w in words], [int(k % 4 == 0) for k in range(600)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(900, None), (901, "unmet"), (None, texts[0])], "doc_id long, text string")
    marks = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(3, 1), (5000, 1), (None, 1), (7, None), (8, 5)], "doc_id long, label long")
    known = docs.where("doc_id < 600")
    index = toxicity.train(known, marks.where("doc_id < 600 and label in (0, 1)"))
    held = {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sorted(index.ids) == [k for k in range(600) if k not in held]  # all examples are in the index
    full = np.zeros((len(index.ids), len(index.terms)))
    for row, (numbers, weights) in zip(full, index.vectors, strict=True):
        row[numbers] = weights
    assert np.allclose((full**2).sum(axis=1), 1)
    scores = []
    for k in sorted(held):
        numbers, weights = index.vector(texts[k])
        near = full[:, numbers] @ weights
        best = np.lexsort((np.arange(len(near)), -np.round(near, 12)))[: toxicity.NEAREST]
        share = index.shares[index.labels[best]] / (1 - near[best] + 0.05)
        vote = (share @ index.labels[best] + index.shares.min() * index.blank) / (share.sum() + index.shares.min())
        score, evidence = index.votes([texts[k]])[0]
        assert np.isclose(score, 1 / (1 + np.exp(-(index.slope * np.log(vote / (1 - vote)) + index.shift))))
        assert [i for i, _, _ in evidence] == [index.ids[j] for j in best] and np.allclose([c for _, _, c in evidence], near[best])
        scores.append(score)
    truth = np.array([labels[k] for k in sorted(held)])
    scores = np.array(scores)
    assert (scores[truth == 1] >= 0.5).mean() >= 0.9 and (scores[truth == 0] < 0.5).mean() >= 0.95
    # Reliability: the mean squared error is far below that of the base rate, and the mean score near the share of label 1.
    assert ((scores - truth) ** 2).mean() < 0.3 * truth.mean() * (1 - truth.mean()) and abs(scores.mean() - truth.mean()) < 0.08
    found = {x.doc_id: x for x in toxicity.toxicity(docs, marks).collect()}
    assert len(found) == 603 and found[900].score == found[900].score and not found[900].evidence and found[None].predicted == found[0].predicted
    one_label = toxicity.toxicity(docs, marks.where("label = 0")).select("score", "predicted").distinct().collect()
    assert all(0 <= x.score < 0.5 and x.predicted == 0 for x in one_label)


def test_ann(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 16))
    data = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0, None] * 8), (9020, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = ann.search(df, every=50, nearest=10).collect()
    want = {q: set(np.argsort(-(vectors @ vectors[q] - 1e9 * (np.arange(1500) == q)))[:10]) for q in range(0, 1500, 50)}
    assert len(found) == 300
    assert np.mean([x.vec_id in want[x.query_id] for x in found]) >= 0.9


def test_ann_prunes_where_vectors_have_structure(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    vectors = centres[rng.integers(0, 60, 4000)] + 0.35 * rng.normal(size=(4000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    router = ann.fit(vectors, 32)
    assert router.probes < 8
    held = np.bincount(router.home(vectors), minlength=32)
    assert held.max() <= 2.5 * held.mean()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = ann.search(df, every=40).collect()
    want = {q: set(np.argsort(-(vectors @ vectors[q] - 1e9 * (np.arange(4000) == q)))[:20]) for q in range(0, 4000, 40)}
    assert len(found) == 2000 and np.mean([x.vec_id in want[x.query_id] for x in found]) >= 0.9


def test_ann_of_repeated_ids_and_ties(spark):
    data = [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (7, [1.0, 1.0]), (5, [1.0, 1.0]), (41, [3.0, -1.0]), (8, [1.0])]
    found = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found)
    assert got == sorted([(20, 1, 41, 3.0), (20, 2, 5, 1.0), (20, 3, 7, 1.0), (20, 4, 20, 0.0), (20, 1, 5, 2.0), (20, 2, 7, 2.0), (20, 3, 20, 0.0), (20, 4, 41, -2.0)])


def test_ann_widens_the_probe():
    router = ann.Router(4, 1, (np.eye(4, dtype=np.float32), np.zeros(4, np.float32), np.eye(4, dtype=np.float32), np.zeros(4, np.float32)))
    asked = np.array([[4.0, 3, 2, 1], [1, 2, 3, 4]])
    assert [x.tolist() for x in router.probed(asked, np.array([2, 3, 30, 25]), 21)] == [[0, 1, 2], [3]]


def test_empty(spark, docs, labels):
    none = docs.limit(0)
    marks = labels.select("doc_id", F.col("quality").alias("label")).limit(0)
    made = [
        exact_dedup.decide(none), exact_dedup.keep_one(none), near_dedup.near_groups(none), near_dedup.keep_one_of_each(none), sharding.shard(none),
        bpe.digests(none, tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        packing.pack(none, tokenizer_file("word_bpe_49k.json")), quality.quality_scores(none, marks), toxicity.toxicity(none, marks),
        language_id.languages(none), line_dedup.dedup_lines(none), ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ]
    assert [df.count() for df in made] == [0] * len(made)
