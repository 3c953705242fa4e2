"""Each stage of the pipeline against brute force, on all that the stage before kept."""

import re

import corpus_pipeline
from chronoweave.llm import near_dedup, packing, quality
from chronoweave.llm.queries import table, tokenizer_file
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def key(row):
    return str(row.doc_id), str(row.text)


def test_stages(spark, docs, tmp_path):
    kept = docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = kept.select("doc_id", "text").collect()
        stage(spark, kept, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            want = packing.pack(kept, tokenizer_file("word_bpe_49k.json"))
            assert after.agg(F.sum("length")).first()[0] == want.agg(F.sum("length")).first()[0]
            assert after.where("start = 0").count() == len(before)
            continue
        assert after.columns == docs.columns
        got = sorted(map(key, after.select("doc_id", "text").collect()))
        if name == "quality":
            labels = table(spark, FOLDER, "labels").select("doc_id", F.col("quality").alias("label"))
            scores = quality.quality_scores(kept.select("doc_id", "text"), labels)
            good = {x.doc_id for x in scores.where("score >= 0.3").collect()}
            assert got == sorted(key(x) for x in before if x.doc_id in good) and 0 < len(got) < len(before)
        elif name == "language":
            assert got == sorted(key(x) for x in before if any(c.isalpha() for c in x.text or ""))
        elif name == "exact_dedup":
            groups = {}
            for x in before:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x.text or ""), []).append((-len(x.text or ""), x.doc_id is None, x.doc_id or 0, key(x)))
            assert got == sorted(min(own)[3] for own in groups.values())
        else:
            prints = {key(x): near_dedup.fingerprint(x.text) % 2**64 for x in before}
            assert set(got) <= set(prints)
            groups = []  # connected by at most two bits: one survivor each
            for k, fp in prints.items():
                near = [g for g in groups if any((fp ^ other).bit_count() <= 2 for _, other in g)]
                groups = [g for g in groups if g not in near] + [[(k, fp), *(x for g in near for x in g)]]
            assert sorted(sum(k in got for k, _ in g) for g in groups) == [1] * len(groups)
        kept = after
    assert number == 4
