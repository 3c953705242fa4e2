"""Live intake as streams: the cascade in batches, catch-up queues, contexts and dwell, debouncing, purges.

What a batch writes goes to a folder of its number, written over when the batch comes again, so that a
batch that failed and was repeated leaves what one run leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators import enrich
from chronoweave.streaming.twins import with_event_time

#: How often a refresh is tried, and the first pause before it is tried again, which doubles.
TRIES, PAUSE_S = 3, 60


def _folder(spark: SparkSession, path: str, schema: str, until: int) -> DataFrame:
    """The rows that batches before number ``until`` wrote under ``path``."""
    try:
        held = spark.read.option("basePath", path).schema(f"{schema}, batch long").parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        held = spark.createDataFrame([], f"{schema}, batch long")
    return held.where(F.col("batch") < until)


def _write(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def classified(rows: DataFrame, last: DataFrame, score: Column, key: str, ts: str, item: str) -> DataFrame:
    """``rows`` with verdict and status: by rules, then by ``score``; undecided ones are deferred.

    ``last(key, before)`` has the text of each key's row before these, which the first of them is compared with.
    """
    order = Window.partitionBy(key).orderBy(ts, item)
    own = F.lag("text").over(order)
    met = rows.withColumns({"own": own, "first": F.row_number().over(order) == 1}).join(last.select(F.col(key).alias("last_key"), "before"), F.col(key).eqNullSafe(F.col("last_key")), "left")
    same = F.coalesce(F.when(F.col("first"), F.col("before")).otherwise(F.col("own")) == F.col("text"), F.lit(False))
    verdict = F.coalesce(enrich.tier0(F.col("event_type"), F.col("value"), same)["verdict"], enrich.tier1(score))
    return met.select(*rows.columns, verdict.alias("verdict"), F.when(verdict.isNull(), "deferred").otherwise("classified").alias("status"))


def classify_batches(stream: DataFrame, path: str, score: Column, key: str, ts: str, item: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls for ``stream``: writes ``classified`` rows of each batch, and the last text of each key, under ``path``."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, ts, item)}
    state = f"{key} {kinds[key]}, at {kinds[ts]}, last_item {kinds[item]}, before string"

    def each(batch: DataFrame, number: int) -> None:
        held = _folder(batch.sparkSession, f"{path}/state", state, number)
        newest = held.groupBy(key).agg(F.max_by("before", F.struct("batch", "at", "last_item")).alias("before"))
        _write(classified(batch, newest, score, key, ts, item), f"{path}/rows", number)
        latest = batch.groupBy(key).agg(F.max(F.struct(F.col(ts).alias("at"), F.col(item).alias("last_item"), F.col("text").alias("before"))).alias("last"))
        _write(latest.select(key, "last.at", "last.last_item", "last.before"), f"{path}/state", number)

    return each


def debounced(df: DataFrame, key: str, ts: str, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(key, at, signals): one row for signals of a key with less than ``quiet`` between them, at the first one's instant."""
    grouped = with_event_time(df, ts, late).groupBy(F.session_window(ts, quiet).alias("w"), key)
    return grouped.agg(F.count("*").alias("signals")).select(key, F.col("w.start").alias("at"), "signals")


def contexts(df: DataFrame, key: str, at: str, context: str) -> DataFrame:
    """(key, at, context, previous, dwell): a row for each change of a key's context, with the one before it and how long that was kept.

    ``at`` is a long; rows count in its order within a batch, and one from before the key's last row counts at that instant. Null contexts don't count.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, since, seen = state.get if state.exists else (None, None, None)
        out = []
        for x, value in pd.concat(list(frames)).dropna(subset=[at, context]).astype({at: "int64"}).sort_values([at, context])[[at, context]].itertuples(index=False):
            x = x if seen is None else max(x, seen)
            if value != last:
                out.append((name[0], x, value, last, None if since is None else x - since))
                last, since = value, x
            seen = x
        if seen is not None:
            state.update((last, since, seen))
        found = pd.DataFrame(out, columns=[key, at, context, "previous", "dwell"])
        yield found.astype({"dwell": "Int64"})

    rows = df.select(key, at, context)
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, {at} long, {context} string, previous string, dwell long", "last string, since long, seen long", "append", GroupStateTimeout.NoTimeout
    )


def new_copies(df: DataFrame, key: str, at: str, text: str, again: int) -> DataFrame:
    """(key, at, text): copies of a key but for those of the text that it copied last, less than ``again`` before. ``at`` is a long."""
    kind = df.schema[key].dataType.simpleString()

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, when = state.get if state.exists else (None, None)
        out = []
        for x, value in pd.concat(list(frames)).dropna(subset=[at, text]).astype({at: "int64"}).sort_values([at, text])[[at, text]].itertuples(index=False):
            if value != last or x - when >= again:
                out.append((name[0], x, value))
            last, when = value, x
        if when is not None:
            state.update((last, when))
        yield pd.DataFrame(out, columns=[key, at, text])

    rows = df.select(key, at, text)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} long, {text} string", "last string, at long", "append", GroupStateTimeout.NoTimeout)


def refresh_queue(queue: DataFrame, late: DataFrame, done: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """The next ``queue(item, tries, due)``: ``late`` items are due at once, ``done`` ones go, ``failed`` ones wait twice as long each time and go after TRIES.

    ``now`` and due are seconds. An item that comes late again while it waits begins anew.
    """
    lost = failed.select("item").distinct().withColumn("lost", F.lit(True))
    kept = queue.join(done.select("item"), "item", "left_anti").join(late.select("item"), "item", "left_anti").join(lost, "item", "left")
    tries = F.col("tries") + F.when(F.col("lost"), 1).otherwise(0)
    wait = F.when(F.col("lost"), now + F.lit(PAUSE_S) * F.pow(F.lit(2), tries - 1).cast("long")).otherwise(F.col("due"))
    again = kept.select("item", tries.cast("int").alias("tries"), wait.alias("due")).where(F.col("tries") < TRIES)
    return again.unionByName(late.select("item").distinct().select("item", F.lit(0).alias("tries"), now.alias("due")))


def purge(spark: SparkSession, table: str, column: str, before: str) -> list[str]:
    """Drop the partitions of ``table`` whose ``column`` is less than ``before``, without a rewrite of others; returns their values."""
    names = [x.partition for x in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    gone = sorted(v for v in (n.split("=", 1)[1] for n in names) if v < before)
    for value in gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = '{value}')")
    return gone


def stale(df: DataFrame, key: str, ts: str, now: Column, after_s: int) -> DataFrame:
    """(key, last): keys whose newest heartbeat is over ``after_s`` old, or missing."""
    from chronoweave.operators.sessions import seconds_between

    last = df.groupBy(key).agg(F.max(ts).alias("last"))
    return last.where(F.col("last").isNull() | (seconds_between(now, F.col("last")) > after_s))
