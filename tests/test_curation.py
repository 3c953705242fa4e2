"""Spelling, tense, routes, comparisons, similar texts, clearing and streams with state."""

import difflib
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import compare
from chronoweave.operators import curation, enrich, ranking
from chronoweave.plans import routes, spelling
from chronoweave.sources import sinks
from chronoweave.streaming import twins


def test_damerau():
    assert [spelling.damerau(a, b) for a, b in (("teh", "the"), ("ca", "abc"), ("", "ab"), ("kitten", "sitting"), ("x", "x"))] == [1, 2, 2, 3, 0]


def test_spelling():
    assert spelling.corrected("what about wednsday and tommorrow?") == "what about wednesday and tomorrow"
    assert spelling.corrected("Monday stays, xyzzy too") == "Monday stays, xyzzy too"


@pytest.mark.parametrize(
    "text, want",
    [
        ("we could have baked bread on tuesday", "past"),
        ("which files did she open", "past"),
        ("I was thinking I might paint the fence", "future"),
        ("could you show the invoices of april", None),
        ("they are going to plant trees", "future"),
        ("recipes with lentils", None),
    ],
)
def test_tense(text, want):
    assert spelling.tense(text) == want


def test_routes(spark):
    assert routes.decide("x", None) is None and routes.fetching(None) == []
    found = routes.decide("x", lambda _: {"memory_query": 0.6, "specific_recall": 0.31, "topic_search": 0.19})
    assert (found.primary, list(found.others)) == ("memory_query", ["specific_recall"]) and routes.fetching(found) == ["memory_query", "specific_recall"]
    assert routes.fetching(routes.decide("hi", lambda _: {"casual": 0.7, "memory_query": 0.3})) == []
    both = routes.together([("a", spark.range(2)), ("b", spark.range(1))])
    assert sorted(tuple(x) for x in both.collect()) == [(0, "a", 0), (0, "a", 1), (1, "b", 0)]


def test_compare(spark):
    rows = [("abcd", "bcde"), ("", ""), (None, "x"), ("a" * 50, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(compare.sequence_ratio(F.col("a"), F.col("b"), 0.5).alias("r"), compare.damerau_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [x.r for x in got] == [difflib.SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0, 0.0, 0.0] and [x.d for x in got] == [2, 0, 1, 49]
    long = "\n".join(map(str, range(900)))
    pages = spark.createDataFrame([("x", "y"), (long, long.replace("500", "none")), (None, None)], "a string, b string")
    told = [x.t for x in pages.select(compare.change_report(F.col("a"), F.col("b")).alias("t")).collect()]
    assert told[0] == "before:\nx\nafter:\ny" and "-500" in told[1].split("\n") and "+none" in told[1].split("\n") and told[2] == "before:\n\nafter:\n"
    assert [compare.first_string(x) for x in ('{"a": 1, "b": " ", "c": "yes"}', '"word"', "plain", " ", None, '{"a": 1}')] == ["yes", "word", "plain", None, None, None]


def test_similar_pairs(spark):
    random.seed(4)
    texts = [" ".join(random.choices("abcdefghijklmnop", k=random.randint(0, 9))) for _ in range(300)] + [None]
    rows = [(k % 2, k, t) for k, t in enumerate(texts)]
    found = {(x.g, x.a, x.b) for x in curation.similar_pairs(spark.createDataFrame(rows, "g int, id long, t string"), ["g"], "id", "t", 0.6).collect()}
    first = {}
    for g, k, t in rows:
        first.setdefault((g, frozenset((t or "").split())), k)
    want = {
        (g, a, b) for (g, s), a in first.items() for (h, t), b in first.items()
        if g == h and a < b and s and t and len(s & t) / len(s | t) >= 0.6 - 1e-9
    }
    assert found == want and len(want) > 20


def test_similar_texts_lose_no_link(spark):
    """Copies, texts of the same words, repeated and null items and null buckets keep their links, by classes and their members."""
    random.seed(11)
    texts = [" ".join(random.choices("abcdefgh", k=random.randint(1, 8))) for _ in range(120)] + ["x y z", "z y x", "x y z", " . ", None]
    rows = [((None, "u", "v")[k % 3], k % 7 if k % 7 < 6 else None, t) for k, t in enumerate(texts)]
    members, pairs = curation.similar_texts(spark.createDataFrame(rows, "g string, id long, t string"), ["g"], "id", "t", 0.6)
    held, near = members.collect(), {(x.g, x.class_a, x.class_b): (x.a, x.b) for x in pairs.collect()}
    name = lambda t: hashlib.md5(" ".join(sorted({*t.split()})).encode()).hexdigest() if t and t.strip(" .") else None
    assert sorted(map(str, ((x.g, x["class"], x.item) for x in held))) == sorted(map(str, ((g, name(t), k) for g, k, t in rows)))
    first = {}
    for g, k, t in rows:
        if name(t):
            first.setdefault((g, name(t)), ({*t.split()}, []))[1].extend([] if k is None else [k])
    want = {
        (g, a, b): (min(m, default=None), min(n, default=None)) for (g, a), (s, m) in first.items() for (h, b), (t, n) in first.items()
        if g == h and a < b and len(s & t) / len(s | t) >= 0.6 - 1e-9
    }
    assert near == want and len(want) > 20 and pairs.count() == len(want)
    assert any(a == b for a, b in want.values()) and any(g is None for g, _, _ in want)
    assert [len({x["class"] for x in held if x.g == g and x["class"] == name("x y z")}) for g in (None, "u", "v")] == [1, 1, 1]


def test_candidates_are_few(spark):
    """Texts that share their rarest word and little else: sets meet in pairs only where they can be similar."""
    random.seed(6)
    common = [f"c{k}" for k in range(60)]
    rows = [(1, k, sorted({f"a{k % 4}", *random.sample(common, 20)})) for k in range(200)]
    rows += [(1, 200 + k, sorted({*rows[k][2][:-1], "zz"})) for k in range(10)]
    classes = spark.createDataFrame(rows, "g int, item long, set array<string>")
    found = {(x.a, x.b) for x in curation.candidate_pairs(classes, ["g"], 0.8).collect()}
    want = {(a, b) for _, a, s in rows for _, b, t in rows if a < b and len({*s} & {*t}) >= 0.8 * len({*s} | {*t}) - 1e-9}
    assert want <= found and len(want) >= 10 and len(found) <= 2 * len(want)  # 210 sets, four of whose rarest words are in 50 each


def test_near_any_with_repeated_and_long_sets(spark):
    random.seed(9)
    letters = [f"w{k}" for k in range(40)]
    texts = [" ".join(random.sample(letters, random.randint(1, 30))) for _ in range(150)] + ["", None]
    golden = [" ".join([*(t or "").split()[1:], "new"]) for t in texts[::3]] + texts[:5]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = {x.item for x in curation.near_any(rows, "id", "t", spark.createDataFrame([(g,) for g in golden], "g string"), "g", 0.85).collect()}
    sets = [{*g.split()} for g in golden if g.strip()]
    want = {k for k, t in enumerate(texts) if t and any(len({*t.split()} & s) >= (0.85 - 1e-9) * len({*t.split()} | s) for s in sets)}
    assert found == want and len(want) > 10


def test_artifacts_and_budget(spark):
    df = spark.createDataFrame([(1, 1, "aa bb"), (2, 2, "aa"), (3, 3, " "), (4, 4, "cc")], "id int, ts int, t string")
    assert [x.id for x in ranking.artifacts(df, "t", ["aa", "bb"], "ts", "id", 5).collect()] == [1, 2]
    assert [x.id for x in ranking.artifacts(df, "t", [], "ts", "id", 2).collect()] == [4, 2]
    assert ranking.artifacts(df, "t", [], "ts", "id", 2, fall_back=False).count() == 0
    kept = ranking.within_budget(df.withColumn("g", F.lit(0)), "g", "id", "t", 6)
    assert [(x.id, x.t) for x in kept.orderBy("id").collect()] == [(1, "aa bb"), (2, "a")]


def test_cleared(spark):
    facts = spark.createDataFrame([(1, "distiller", [1.0]), (1, "agent", [3.0]), (2, "distiller", [1.0])], "cluster_id int, source string, embedding array<double>")
    left = sinks.cleared({"events": spark.range(3), "sessions": spark.range(2), "conversations": spark.range(2), "facts": facts}, ["events"])
    assert {k: v.count() for k, v in left.items()} == {"events": 0, "sessions": 0, "conversations": 2, "facts": 1, "clusters": 1}
    assert left["clusters"].first().centroid == [3.0]
    assert sinks.cleared({"facts": facts, "conversations": spark.range(2)}, ["memory"])["facts"].count() == 0


def test_streams_with_state(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "value").withColumn("at", F.col("event_id"))
    half = events.agg(F.max("event_id")).first()[0] // 2
    for part in (events.where(F.col("event_id") <= half), events.where(F.col("event_id") > half)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("means", twins.ewma(stream, "user_id", "event_id", "value")), ("fired", twins.alerts(stream, "user_id", "at", 50))):
        df.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    got = spark.sql("SELECT user_id, max_by(mean, n) AS mean, max(n) AS n FROM means GROUP BY user_id")
    want = enrich.ewma_last(events, "user_id", "event_id", "value")
    assert {(x.user_id, x.n, round(x["mean"], 9)) for x in got.collect()} == {(x.user_id, x.n, round(x["mean"], 9)) for x in want.collect()}
    fires = events.groupBy("user_id").agg(F.array_sort(F.collect_list("at")).alias("at")).select("user_id", enrich.fires(F.col("at"), 50).alias("n"))
    assert {(x.user_id, x["count"]) for x in spark.table("fired").groupBy("user_id").count().collect()} == {(x.user_id, x.n) for x in fires.collect()}
