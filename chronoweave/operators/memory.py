"""Long-term memory and grouping in order: profile fields, item lists, greedy groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESTABLISHED = 5


def settled_scalar(values: Column) -> Column:
    """(value, mentions) after the values of an array were set in order.

    Once a value counts ``ESTABLISHED`` mentions another no longer takes its place; every mention counts.
    An empty array gives null with 0 mentions.
    """
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("mentions"))

    def step(held: Column, new: Column) -> Column:
        stays = held["mentions"] >= ESTABLISHED
        return F.struct(F.when(stays, held["value"]).otherwise(new).alias("value"), (held["mentions"] + 1).alias("mentions"))

    return F.aggregate(values, start, step)


def takes_precedence(old_source: Column, new_source: Column) -> Column:
    """Whether a new value may take the place of an old one: a user's always, a distiller's not that of an agent."""
    free = ~((new_source == "distiller") & (old_source == "agent"))
    return F.coalesce((new_source == "user") | free, F.lit(True))


def merged_items(old: Column, new: Column) -> Column:
    """Two maps of name to struct(count, last_seen) as one: counts add up, the later sight counts."""
    return F.map_zip_with(
        F.coalesce(old, F.create_map().cast("map<string, struct<count: bigint, last_seen: timestamp_ntz>>")),
        F.coalesce(new, F.create_map().cast("map<string, struct<count: bigint, last_seen: timestamp_ntz>>")),
        lambda _, a, b: F.struct(
            (F.coalesce(a["count"], F.lit(0)) + F.coalesce(b["count"], F.lit(0))).alias("count"),
            F.greatest(a["last_seen"], b["last_seen"]).alias("last_seen"),
        ),
    )


def active_names(items: Column, since: Column) -> Column:
    """The names of a map of items that were seen after ``since``, the most frequent first, ties by name."""
    active = F.filter(F.map_entries(items), lambda e: e["value"]["last_seen"] > since)
    ordered = F.array_sort(F.transform(active, lambda e: F.struct((-e["value"]["count"]).alias("n"), e["key"].alias("name"))))
    return F.array_join(F.transform(ordered, lambda e: e["name"]), ", ")


def _by_group(df: DataFrame, group: list[str], column: str, kind: str, number: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """``df`` with a column that ``number`` gives for the rows of each group; null groups are groups."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{column: number(rows)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {column} {kind}"
    return df.groupBy(*group).applyInPandas(run, schema)


def leader_clusters(df: DataFrame, group: list[str], order: str, vector: str, least: float) -> DataFrame:
    """``df`` with leader, the ``order`` value of the first row of its cluster.

    In order, a row joins the first leader of its group with a cosine of ``least`` or more, else it
    leads. A null vector leads itself. The result depends on the order, so a group is the work of one
    task: groups must be bounded, as sessions of a range of time are.
    """

    def number(rows: pd.DataFrame) -> np.ndarray:
        keys, vectors = rows[order].to_numpy(), rows[vector].to_list()
        out, leaders, units = keys.copy(), [], []
        for k in np.argsort(keys, kind="stable"):
            own = None if vectors[k] is None else np.asarray(vectors[k], np.float64)
            size = 0.0 if own is None else float(np.sqrt(own @ own))
            if not size:
                continue
            hits = np.flatnonzero(np.array(units) @ (own / size) >= least) if units else []
            if len(hits):
                out[k] = leaders[hits[0]]
            else:
                leaders.append(keys[k])
                units.append(own / size)
        return out

    return _by_group(df, group, "leader", df.schema[order].dataType.simpleString(), number)


def _in_order(df: DataFrame, group: list[str], ts_ms: str, mark: str, start: Column) -> DataFrame:
    """``df`` with start_, by ``start`` of the instant before (prior_, null at a group's first row), in order of instants within each group; ties by mark, then by the other columns."""
    rest = [c for c, kind in df.dtypes if c not in (*group, ts_ms, mark) and not kind.startswith(("map", "variant"))]
    order = [ts_ms, mark, *rest]
    prior = df.withColumn("prior_", F.lag(ts_ms).over(Window.partitionBy(*group).orderBy(*order)))
    return prior.withColumn("start_", start).drop("prior_").sortWithinPartitions(*group, *order)


def _with(df: DataFrame, column: str, kind: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {column} {kind}"


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values, 0 for null, and which are null."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _joined(at: np.ndarray, marks: np.ndarray, gone: np.ndarray, bits: int, span_ms: int) -> np.ndarray:
    """The group of each of some frames in order, none of which is over ``span_ms`` after the one before."""
    root, low, high = list(range(len(at))), at.tolist(), at.tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    stops = np.searchsorted(at, at + span_ms, "right")
    for i in range(len(at)):
        near = (np.bitwise_count((marks[i + 1 : stops[i]] ^ marks[i]).view(np.uint64)) <= bits) & ~gone[i + 1 : stops[i]]
        for j in (np.flatnonzero(near) + i + 1).tolist() if not gone[i] else ():
            a, b = find(i), find(j)
            if a != b and max(high[a], high[b]) - min(low[a], low[b]) <= span_ms:
                root[b] = a
                low[a], high[a] = min(low[a], low[b]), max(high[a], high[b])
    return np.array([low[find(i)] for i in range(len(at))], np.int64)


def frame_groups(df: DataFrame, group: list[str], ts_ms: str, mark: str, bits: int = 2, span_ms: int = 30_000) -> DataFrame:
    """``df`` with frame_group, the first ``ts_ms`` of the frames that look alike.

    Frames whose 64-bit ``mark`` differs in ``bits`` or fewer within ``span_ms`` join, as long as the
    whole group spans ``span_ms`` or less; pairs are taken in order, so that long runs don't chain. Frames
    with a gap over ``span_ms`` between them can't join, so a task holds the rows between two such gaps at once, and a batch
    holds many groups. Frames without mark or instant stay alone.
    """
    columns = df.columns

    def numbered(rows: pa.RecordBatch) -> pa.RecordBatch:
        (at, timeless), (marks, blank) = _longs(rows[ts_ms]), _longs(rows[mark])
        out, gone = at.copy(), timeless | blank
        starts = np.flatnonzero(rows["start_"].to_numpy(zero_copy_only=False))
        ends = np.append(starts[1:], len(at))
        for k in np.flatnonzero(ends - starts > 1):
            i, j = starts[k], ends[k]
            out[i:j] = _joined(at[i:j], marks[i:j], gone[i:j], bits, span_ms)
        return pa.RecordBatch.from_arrays([*(rows[c] for c in columns), pa.array(out, mask=timeless)], names=[*columns, "frame_group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch["start_"].to_numpy(zero_copy_only=False))
            if len(starts) and (held or starts[-1]):
                yield numbered(pa.concat_batches([*held, batch.slice(0, starts[-1])]))
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield numbered(pa.concat_batches(held))

    apart = F.coalesce(F.col(ts_ms) - F.col("prior_") > span_ms, F.lit(True))
    return _in_order(df, group, ts_ms, mark, apart).mapInArrow(run, _with(df, "frame_group", "long"))


def kept_frames(df: DataFrame, group: list[str], ts_ms: str, mark: str, bits: int = 2, gap_ms: int = 0) -> DataFrame:
    """``df`` with kept: a frame is dropped when it is like the last one kept, or within ``gap_ms`` of it.

    Rows pass in order, with one frame as state; those without mark or instant are kept and compared with none.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, own = False, 0, 0
        for batch in batches:
            (times, timeless), (marks, blank) = _longs(batch[ts_ms]), _longs(batch[mark])
            kept = []
            for start, t, m, gone in zip(batch["start_"].to_pylist(), times.tolist(), marks.tolist(), (timeless | blank).tolist(), strict=True):
                seen = seen and not start
                if gone:
                    kept.append(True)
                    continue
                stays = not seen or (t - at >= gap_ms and ((m ^ own) & 0xFFFFFFFFFFFFFFFF).bit_count() > bits)
                if stays:
                    seen, at, own = True, t, m
                kept.append(stays)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(kept, pa.bool_())], names=[*columns, "kept"])

    return _in_order(df, group, ts_ms, mark, F.col("prior_").isNull()).mapInArrow(run, _with(df, "kept", "boolean"))
