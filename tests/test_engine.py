"""Planners, sources, sinks and streaming twins."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import vector
from chronoweave.operators import enrich
from chronoweave.plans import guard, intent, temporal
from chronoweave.sources import readers, sinks
from chronoweave.streaming import twins

NOW = datetime(2026, 8, 6, 14, 0)  # a Thursday


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("what did I do yesterday", datetime(2026, 8, 5), datetime(2026, 8, 6)),
        ("last 3 days", datetime(2026, 8, 3, 14), NOW),
        ("on monday", datetime(2026, 8, 3), datetime(2026, 8, 4)),
        ("last weekend", datetime(2026, 8, 1), datetime(2026, 8, 3)),
        ("last month", datetime(2026, 7, 1), datetime(2026, 8, 1)),
        ("screenshot from 8/4/2026, 1:12:29 PM", datetime(2026, 8, 4, 13, 12, 27), datetime(2026, 8, 4, 13, 12, 31)),
        ("today", datetime(2026, 8, 6), NOW),
        ("in december", datetime(2025, 12, 1), datetime(2026, 1, 1)),
    ],
)
def test_temporal(text, start, end):
    found = temporal.resolve(text, NOW)
    assert (found.start, found.end) == (start, end)


@pytest.mark.parametrize("text", ["this weekend", "what will I do tomorrow", "hello there"])
def test_no_range(text):
    assert temporal.resolve(text, NOW) is None


def test_tier():
    assert temporal.select_tier(temporal.resolve("last 2 hours", NOW), NOW) == "events"
    assert temporal.select_tier(temporal.resolve("last month", NOW), NOW) == "sessions"
    assert temporal.select_tier(temporal.resolve("in december", NOW), NOW) == "facts"


def test_guard():
    assert guard.is_select("SELECT 1") and not guard.is_select("WITH a AS (SELECT 1) SELECT 1")
    assert not guard.is_select("SELECT * FROM t WHERE x LIKE '%update%'")
    assert guard.where_fragment("SELECT a FROM t WHERE a > 1 ORDER BY a") == "a > 1"


def test_intent():
    assert intent.recency("the last 3 days") == "window" and intent.recency("latest page") == "soft" and intent.recency("x") is None
    assert intent.artifact("what I copied") == "clipboard" and intent.route("how many hours") == "aggregation"


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"label": "a", "flagged": false}\n\n{bad\n{"label": "b", "flagged": true}\n{"label": "z"}\n')
    assert readers.read_jsonl_tolerant(spark, str(tmp_path / "a.jsonl"), "label string, flagged boolean", ["a", "b"]).count() == 1
    assert readers.read_json_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    lines = ["ann|a@x", "3\t1\tf.py", "-\t-\tb.bin", "bob|b@x", "2\t2\tg.py", "ann|a@x", "1\t0\tf.py"]
    df = spark.createDataFrame(list(enumerate(lines)), "position int, value string")
    assert {tuple(x) for x in readers.parse_numstat(df).collect()} == {("ann", 2, 4, 1), ("bob", 1, 2, 2)}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.replace_table(spark.range(3).toDF("id"), path)
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(x.id for x in spark.read.parquet(path).collect()) == [1, 2]
    rows = spark.createDataFrame([(1, None), (2, True)], "id int, gone boolean")
    assert [x.id for x in sinks.delete_where(rows, F.col("gone")).collect()] == [1]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 5.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = df.select(F.round(vector.cosine("a", "b"), 4).alias("x"), F.round(vector.cosine_cut("a", "b"), 4).alias("y")).collect()
    assert [(x.x, x.y) for x in got] == [(0.1961, 1.0), (0.0, 0.0)]


def test_ewma_prefix(spark):
    df = spark.createDataFrame([("a", k, float(k)) for k in range(3)], "k string, o long, x double")
    states = enrich.ewma_states(df, "k", "o", "x").first().states
    assert [s.n for s in states] == [0, 1, 2] and abs(states[1].mean - 0.05) < 1e-12
    last = enrich.ewma_last(df, "k", "o", "x").first()
    assert (last.n, last.mean, last["var"]) == (states[2].n, states[2].mean, states[2].var)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = twins.tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type", "ts")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(x) for x in spark.sql("SELECT event_type, window_start, n FROM counts").collect()}
    want = events.groupBy("event_type", F.window("ts", "1 hour")["start"].alias("w")).agg(F.count("*").alias("n"))
    assert got == {(x.event_type, x.w, x.n) for x in want.collect()}
    twins.run_available(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == events.count()


def test_leader_clusters(spark):
    from chronoweave.operators.memory import leader_clusters

    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0]), (4, None), (5, [0.6, 0.8]), (6, [0.0, 0.0])]
    found = leader_clusters(spark.createDataFrame([(0, *r) for r in rows], "g int, id long, v array<double>"), ["g"], "id", "v", 0.75)
    # 5 is near 2, which leads nothing, and near 3, which leads.
    assert {x.id: x.leader for x in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6}


def test_frame_groups(spark):
    from chronoweave.operators.memory import frame_groups, kept_frames

    frames = spark.createDataFrame([(0, 1000, 0), (0, 21000, 0), (0, 41000, 0), (0, 42000, -1)], "g int, ts_ms long, mark long")
    sizes = {x.frame_group: x["count"] for x in frame_groups(frames, ["g"], "ts_ms", "mark").groupBy("frame_group").count().collect()}
    assert sizes == {1000: 2, 41000: 1, 42000: 1}
    assert [x.kept for x in kept_frames(frames, ["g"], "ts_ms", "mark").orderBy("ts_ms").collect()] == [True, False, False, True]
    assert frame_groups(frames.limit(0), ["g"], "ts_ms", "mark").count() == 0


def test_hashed_embedding(spark):
    from chronoweave.functions.text import hashed_embedding

    rows = spark.createDataFrame([("one two",), ("two one",), ("",), (None,)], "t string").select(hashed_embedding("t").alias("e")).collect()
    norms = [round(sum(x * x for x in r.e), 9) for r in rows]
    assert norms == [1.0, 1.0, 0.0, 0.0] and rows[0].e != rows[1].e and len(rows[0].e) == 384
