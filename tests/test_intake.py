"""Live intake against batch runs: repeated batches, late and repeated rows, given clocks."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoweave.streaming import intake, twins

KIND = "event_id long, user_id long, ts timestamp, event_type string, value double, text string"


@pytest.fixture(scope="module")
def rows(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(600)
    text = F.concat(F.col("event_type"), (F.col("event_id") % 2).cast("string"))
    return own.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", text.alias("text")).orderBy("ts", "event_id").toPandas()


def feed(spark, rows, path, parts, kind=KIND):
    """``rows`` as files, one for each batch."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows.iloc[k * size : (k + 1) * size], kind).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(path))


def test_cascade_in_batches_equals_one_and_survives_a_failure(spark, rows, tmp_path):
    score, keys = F.col("value") / 4, ("user_id", "ts", "event_id")
    stream = feed(spark, rows, tmp_path / "in", 3)
    out, calls = str(tmp_path / "out"), []
    write = intake.classify_batches(stream, out, score, *keys)

    def each(batch, number):
        calls.append(number)
        write(batch, number)
        if calls == [0, 1]:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        twins.run_available(stream, each, str(tmp_path / "cp"))
    twins.run_available(stream, each, str(tmp_path / "cp"))
    assert calls == [0, 1, 1, 2]
    df = spark.createDataFrame(rows, KIND)
    none = spark.createDataFrame([], "user_id long, before string")
    want = intake.classified(df, none, score, *keys).select("event_id", "verdict", "status").collect()
    found = spark.read.parquet(f"{out}/rows").select("event_id", "verdict", "status").collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, want), key=str) and {x.status for x in found} == {"classified", "deferred"}


def test_contexts_equal_batch_windows(spark, rows, tmp_path):
    some = rows[["user_id", "event_id", "event_type"]].rename(columns={"event_id": "at", "event_type": "context"}).sort_values("at")
    kind = "user_id long, at long, context string"
    stream = feed(spark, some, tmp_path / "in", 3, kind)
    out = str(tmp_path / "out")
    query = intake.contexts(stream, "user_id", "at", "context").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start().awaitTermination()
    own = Window.partitionBy("user_id").orderBy("at")
    changes = spark.createDataFrame(some, kind).withColumn("previous", F.lag("context").over(own)).where("previous is null or previous != context")
    want = changes.withColumn("dwell", F.col("at") - F.lag("at").over(own)).select("user_id", "at", "context", "previous", "dwell").collect()
    assert sorted(map(tuple, spark.read.parquet(out).select("user_id", "at", "context", "previous", "dwell").collect()), key=str) == sorted(map(tuple, want), key=str)


def test_copies_of_the_last_text_are_left_out(spark, tmp_path):
    import pandas as pd

    data = pd.DataFrame([(1, 0, "a"), (1, 5, "a"), (1, 20, "a"), (2, 3, "a"), (1, 21, "b"), (1, 22, "a"), (1, 23, "a")], columns=["user_id", "at", "text"])
    kind = "user_id long, at long, text string"
    stream = feed(spark, data, tmp_path / "in", 2, kind)
    out = str(tmp_path / "out")
    intake.new_copies(stream, "user_id", "at", "text", 10).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 0, "a"), (1, 20, "a"), (1, 21, "b"), (1, 22, "a"), (2, 3, "a")]


def test_signals_within_two_seconds_are_one(spark, tmp_path):
    import pandas as pd

    at = [0.0, 0.5, 2.1, 7.0, 8.9, 30.0, 7.9, 100.0, 1.0]  # not in order
    data = pd.DataFrame({"user_id": 1, "ts": [pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=x) for x in at]})
    kind = "user_id long, ts timestamp"
    stream = feed(spark, data, tmp_path / "in", len(at), kind)
    out = str(tmp_path / "out")
    intake.debounced(stream, "user_id", "ts").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    found = sorted((x.at.second, x.signals) for x in spark.read.parquet(out).collect())
    # The row of 7.9 comes a batch after that of 30, before the watermark that this sets rules rows out; that of 1.0 comes too late.
    assert found == [(0, 3), (7, 3), (30, 1)]


def test_refresh_queue_by_given_clocks(spark):
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "item string")
    queue = spark.createDataFrame([], "item string, tries int, due long")
    turns = [(0, ["a", "b"], [], []), (10, ["c"], ["b"], ["a"]), (70, [], [], ["a", "c"]), (200, ["c"], [], ["a"]), (300, [], ["c"], [])]
    want = [{"a": (0, 0), "b": (0, 0)}, {"a": (1, 70), "c": (0, 10)}, {"a": (2, 190), "c": (1, 130)}, {"c": (0, 200)}, {}]
    for (now, late, done, failed), after in zip(turns, want, strict=True):
        queue = intake.refresh_queue(queue, frame(late), frame(done), frame(failed), F.lit(now).cast("long"))
        queue = spark.createDataFrame(queue.collect(), "item string, tries int, due long")
        assert {x.item: (x.tries, x.due) for x in queue.collect()} == after


def test_purge_drops_partitions_without_a_rewrite(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS kept_days")
    days = spark.range(40).selectExpr("id", "concat('2024-01-', lpad(cast(id % 8 + 1 as string), 2, '0')) day")
    days.write.partitionBy("day").option("path", str(tmp_path / "t")).saveAsTable("kept_days")
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")}
    before = files()
    assert intake.purge(spark, "kept_days", "day", "2024-01-04") == ["2024-01-01", "2024-01-02", "2024-01-03"]
    spark.sql("REFRESH TABLE kept_days")
    left = spark.table("kept_days").selectExpr("min(day)", "count(*)").first()
    assert tuple(left) == ("2024-01-04", 25) and all(before[k] == v for k, v in files().items())
    spark.sql("DROP TABLE kept_days")


def test_stale_heartbeats(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:50"), ("b", "2024-01-01 00:00:10"), ("c", None)], "name string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    assert {x.name for x in intake.stale(df, "name", "at", F.to_timestamp_ntz(F.lit("2024-01-01 00:01:00")), 30).collect()} == {"b", "c"}
