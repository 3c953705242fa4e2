"""Streaming twins of the batch operators; all take a streaming frame and return one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.operators.enrich import ALPHA


def with_event_time(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Instants with a time zone, and a watermark; rows later than ``late`` may be dropped."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, window_start, window_end, event_count) of each session; its end is the last event plus the gap."""
    grouped = with_event_time(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("event_count")).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_count")


def tumbling_counts(df: DataFrame, key: str, ts: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, window_start, n): rows in each tumbling window, or sliding one."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = with_event_time(df, ts, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n")


def insert_or_ignore(df: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return with_event_time(df, ts, late).dropDuplicatesWithinWatermark([key])


def run_available(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there in batches and stop; ``each`` gets every batch once more after a failure in it."""
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ewma(df: DataFrame, key: str, order: str, value: str, alpha: float = ALPHA) -> DataFrame:
    """(key, n, mean, var) of each key that had rows in a batch, as ``enrich.ewma_last`` has it; the state is three numbers.

    Rows count in order within a batch; a row that comes after its batch counts when it comes. Null values don't count.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, var = state.get if state.exists else (-1, 0.0, 0.0)
        rows = pd.concat(list(frames)).dropna(subset=[value])
        for x in rows.sort_values(order)[value].astype(float):
            delta = x - mean
            n, mean, var = n + 1, x if n < 0 else alpha * x + (1 - alpha) * mean, 0.0 if n < 0 else (1 - alpha) * (var + alpha * delta * delta)
        state.update((n, mean, var))
        yield pd.DataFrame({key: [name[0]], "n": [n], "mean": [mean], "var": [var]})

    rows = df.select(key, order, value)
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, n long, mean double, var double", "n long, mean double, var double", "update", GroupStateTimeout.NoTimeout
    )


def alerts(df: DataFrame, key: str, at: str, cooldown: int) -> DataFrame:
    """(key, at) of the instants that fire: none within ``cooldown`` of the key's last that did. ``at`` is a long."""
    kind = df.schema[key].dataType.simpleString()

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, fired = state.get[0] if state.exists else None, []
        for x in pd.concat(list(frames))[at].dropna().astype("int64").sort_values().tolist():
            if last is None or x - last >= cooldown:
                last = x
                fired.append(x)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [name[0]] * len(fired), at: fired})

    rows = df.select(key, at)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} long", "last long", "update", GroupStateTimeout.NoTimeout)
