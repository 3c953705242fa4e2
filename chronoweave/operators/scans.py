"""Running states over ordered rows of keys of any size, by range partitions that hand their state on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.sources.shared import staged


def affine_scan(df: DataFrame, key: str, order: list[str], factor: str, shift: str, start: str, path: str, name: str) -> DataFrame:
    """``df`` with ``name``, the state after each row, ``name_before``, the one before it (null at a key's first row), and ``name_n``, the rows of the key before it.

    By ``order`` within its key, which tells rows apart, a row takes the state to ``factor * state + shift``; the first one sets it to
    ``start``. Rows are sorted in range partitions, so that a key of any size is dealt to many tasks. A task composes the maps of its
    rows as it goes; only a partition's first key can have begun in an earlier one, so one state for
    each partition is handed on, and applied by a broadcast join of as many rows as there are partitions. Keys may be null.
    """
    columns = df.columns
    ordered = df.repartitionByRange(F.col(key).asc_nulls_first(), *order).sortWithinPartitions(F.col(key).asc_nulls_first(), *order)
    extra = [f"{name}_{c}" for c in ("part", "seq", "run", "a", "b", "own", "pa", "pb", "prior", "count")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, number, last, begun = TaskContext.get().partitionId(), 0, -1, None, False
        a = b = own = 0.0
        count = 0
        for batch in batches:
            rows = batch.num_rows
            out = {c: np.zeros(rows) for c in ("a", "b", "own", "pa", "pb", "prior")}
            runs, counts = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            keys = batch[key].to_pylist()
            maps = [batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (factor, shift, start)]
            for k, (value, f, s, first) in enumerate(zip(keys, *(x.tolist() for x in maps), strict=True)):
                if not begun or value != last:
                    number, last, begun, count = number + 1, value, True, 0
                    out["pa"][k], out["pb"][k], out["prior"][k] = 1.0, 0.0, np.nan
                    a, b, own = f, s, first
                else:
                    out["pa"][k], out["pb"][k], out["prior"][k] = a, b, own
                    a, b, own, count = f * a, f * b + s, f * own + s, count + 1
                out["a"][k], out["b"][k], out["own"][k], runs[k], counts[k] = a, b, own, number, count
            made = [pa.array(np.full(rows, part)), pa.array(seq + np.arange(rows)), pa.array(runs), *(pa.array(out[c]) for c in ("a", "b", "own", "pa", "pb", "prior")), pa.array(counts)]
            seq += rows
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *made], names=[*columns, *extra])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]
    kinds += [f"{c} {'long' if c.rsplit('_', 1)[1] in ('part', 'seq', 'run', 'count') else 'double'}" for c in extra]
    part, seq, runs, a, b, own, before_a, before_b, prior, count = extra
    rows = staged(ordered.mapInArrow(run, ", ".join(kinds)), path)
    # A row for each partition: its first key, and its last run's key, number and maps.
    ends = rows.groupBy(part).agg(F.min_by(F.struct(F.col(key).alias("k")), seq).alias("first"), F.max_by(F.struct(F.col(key).alias("k"), runs, a, b, own, count), seq).alias("last")).orderBy(part).collect()
    handed, state, before, seen = [], None, None, 0
    for x in ends:
        carried = before is not None and x.first.k == before.k
        if carried:
            handed.append((x[part], state, seen))
        single = x.last[runs] == 0
        state = x.last[a] * state + x.last[b] if carried and single else x.last[own]
        seen = x.last[count] + 1 + (seen if carried and single else 0)
        before = x.last
    given = rows.sparkSession.createDataFrame(handed, "h_part long, h_state double, h_seen long")
    met = rows.join(F.broadcast(given), (F.col(part) == F.col("h_part")) & (F.col(runs) == 0), "left")
    fresh = F.col("h_state").isNull()
    return met.select(
        *columns,
        F.when(fresh, F.col(own)).otherwise(F.col(a) * F.col("h_state") + F.col(b)).alias(name),
        F.when(~fresh, F.col(before_a) * F.col("h_state") + F.col(before_b)).when(~F.isnan(prior), F.col(prior)).alias(f"{name}_before"),
        (F.col(count) + F.coalesce("h_seen", F.lit(0))).alias(f"{name}_n"),
    )


def ewma_scan(df: DataFrame, key: str, order: list[str], value: str, path: str, alpha: float) -> DataFrame:
    """``df`` with mean, var and n after each row: the exponentially weighted mean and variance of the key's values, and the values before it.

    Two scans: the mean is affine in itself, and so is the variance once the mean before each row is known. Null values don't count.
    """
    real = df.where(F.col(value).isNotNull()).withColumns({"x_": F.col(value).cast("double"), "keep_": F.lit(1.0 - alpha)})
    mean = affine_scan(real.withColumn("add_", alpha * F.col("x_")), key, order, "keep_", "add_", "x_", f"{path}/mean", "mean")
    delta = F.coalesce(F.col("x_") - F.col("mean_before"), F.lit(0.0))
    spread = mean.withColumns({"add_": (1 - alpha) * alpha * delta * delta, "none_": F.lit(0.0)})
    both = affine_scan(spread, key, order, "keep_", "add_", "none_", f"{path}/var", "var")
    return both.select(*df.columns, "mean", "var", F.col("var_n").alias("n"))


def trailing_counts(df: DataFrame, keys: list[str], ts: str, span_s: int, name: str, bucket_s: int = 3600) -> DataFrame:
    """``df`` with ``name``, how many rows of its keys lie within ``span_s`` seconds before its instant, both bounds and the row itself included.

    A range frame counts its rows anew for each row, which is quadratic for frequent keys. Here a count is the difference of two
    running ones, up to the instant and up to just before its span. They run within buckets of time, so that a frequent
    key is dealt to many tasks, and sums of whole buckets are added. Keys may be null; rows without an instant count each other.
    """
    at, width = F.unix_micros(F.col(ts).cast("timestamp")), bucket_s * 1_000_000
    names = [f"key_{k}" for k in range(len(keys))]
    own = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    rows = df.groupBy(*own, at.alias("for_")).agg(F.count("*").alias("n_"))
    ends = rows.select(*names, "for_", F.col("for_").alias("at_"), "n_", F.lit(1).alias("sign_"))
    starts = rows.where("for_ is not null").select(*names, "for_", F.col("for_") - (span_s * 1_000_000 + 1), F.lit(0).cast("long"), F.lit(-1))
    steps = ends.unionAll(starts).withColumn("bucket_", F.floor(F.col("at_") / width))
    whole = steps.groupBy(*names, "bucket_").agg(F.sum("n_").alias("whole_"))
    past = F.sum("whole_").over(Window.partitionBy(*names).orderBy("bucket_")) - F.col("whole_")
    before = whole.select(*(F.col(n).alias(f"b_{n}") for n in names), F.col("bucket_").alias("b_bucket_"), past.alias("past_"))
    within = steps.withColumn("within_", F.sum("n_").over(Window.partitionBy(*names, "bucket_").orderBy("at_")))
    met = within.join(before, [F.col(n).eqNullSafe(F.col(f"b_{n}")) for n in [*names, "bucket_"]])
    total = F.sum(F.col("sign_") * (F.col("past_") + F.col("within_")))
    counts = met.groupBy(*names, "for_").agg(total.alias(name))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return df.join(counts, [*same, at.eqNullSafe(F.col("for_"))]).select(*df.columns, name)
