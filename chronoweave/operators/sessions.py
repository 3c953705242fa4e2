"""Sessions: gaps, islands, caps, coverage by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds as a double, for instants with or without a time zone."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def number_islands(df: DataFrame, key: str, ts: str, gap_s: float, name: str = "island") -> DataFrame:
    """``df`` with the number of each row's session within its key: a gap over ``gap_s`` begins another."""
    order = Window.partitionBy(key).orderBy(ts)
    starts = (seconds_between(F.col(ts), F.lag(ts).over(order)) > gap_s).cast("int")
    return df.withColumn("starts", F.coalesce(starts, F.lit(0))).withColumn(name, F.sum("starts").over(order).cast("long")).drop("starts")


def gap_sessions(df: DataFrame, key: str, ts: str, gap_s: float) -> DataFrame:
    """(key, island, window_start, window_end, event_count) of each session."""
    return number_islands(df, key, ts, gap_s).groupBy(key, "island").agg(
        F.min(ts).alias("window_start"), F.max(ts).alias("window_end"), F.count("*").alias("event_count")
    )


def capped_sessions(df: DataFrame, key: str, ts: str, order_id: str, gap_s: float, cap: int) -> DataFrame:
    """(key, sessions): sessions end at a gap over ``gap_s``, and after ``cap`` rows."""
    islands = number_islands(df, key, ts, gap_s)
    place = F.row_number().over(Window.partitionBy(key, "island").orderBy(ts, order_id)) - 1
    return (
        islands.withColumn("part", F.floor(place / cap))
        .groupBy(key)
        .agg(F.count_distinct("island", "part").alias("sessions"))
    )


def uncovered(df: DataFrame, windows: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows of ``df`` that no row of ``windows(key, window_start, window_end)`` covers; both bounds count as covered."""
    w = windows.select(F.col(key).alias("w_key"), "window_start", "window_end")
    return df.join(w, (df[key] == w["w_key"]) & df[ts].between(w["window_start"], w["window_end"]), "left_anti")


def with_day(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each day that the interval touches, which gives range joins a key to meet on."""
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("interval 1 day"))
    return df.withColumn("day", F.explode(days))
