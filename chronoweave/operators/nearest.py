"""The nearest rows of many query vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast at once.
BLOCK = 2048
#: Rows that are compared with a block at once, so that their cosines fit in a task's memory whatever a batch holds.
ROWS = 512


def nearest_rows(rows: DataFrame, queries: DataFrame, item: str, vector: str, k: int, group: str | None = None, allowed: DataFrame | None = None, block: int = BLOCK, least: float = -2.0) -> DataFrame:
    """(query_id, item, cos, place): the ``k`` rows with the highest cosine, of ``least`` or more, for each of ``queries(query_id, q)``, rounded to 6 digits, ties to the smaller item.

    ``allowed(query_id, group)`` limits a query to rows of some groups. Queries go in blocks of ``block``
    to all rows; each task keeps ``k`` rows of its own a query, so that only those are shuffled. Vectors that are null, zero or hold nulls, and null ids, take no part; all others have one length.
    """
    spark, asked = rows.sparkSession, queries.where("query_id is not null")
    total = asked.count()
    blocks = max(1, -(-total // block))
    columns = [F.col(item).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("vector")] + ([F.col(group).alias("group")] if group else [])
    own = rows.where(F.col(item).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(*columns)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item long, cos double"
    found = None
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        if allowed is not None:
            groups = allowed.groupBy("query_id").agg(F.collect_set("group").alias("groups"))
            mine = mine.join(groups, "query_id")
        table = mine.toArrow()
        shared = spark.sparkContext.broadcast(table)

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = shared.value
            ids = table["query_id"].combine_chunks()
            asked = _unit(np.array(table["q"].to_pylist(), float).reshape(len(ids), -1))
            groups = [set(x) for x in table["groups"].to_pylist()] if "groups" in table.column_names else None
            held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            needed = np.full(len(ids), least)  # what a row needs to be among the k of a query
            for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
                if not len(ids):
                    continue
                unit = _unit(batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                real, items = np.flatnonzero(unit.any(axis=1)), batch["item"].to_numpy(zero_copy_only=False)
                cosines = np.round(asked @ unit[real].T, 6)
                hits = cosines >= needed[:, None]
                if groups:
                    own = [batch["group"][int(k)].as_py() for k in real]
                    names = {g: n for n, g in enumerate(dict.fromkeys(own))}
                    fits = np.zeros((len(groups), len(names)), bool)
                    for query, some in enumerate(groups):
                        fits[query, [names[g] for g in some if g in names]] = True
                    hits &= fits[:, [names[g] for g in own]]
                for query in np.flatnonzero(hits.any(axis=1)):
                    some = np.flatnonzero(hits[query])
                    values, names = np.append(held[query][0], cosines[query][some]), np.append(held[query][1], items[real[some]])
                    first = np.lexsort((names, -values))[:k]
                    held[query] = values[first], names[first]
                    if len(first) == k:
                        needed[query] = values[first[-1]]
            sizes = [len(x) for x, _ in held]
            at = np.repeat(np.arange(len(ids)), sizes)
            values, names = (np.concatenate([x[c] for x in held]) if held else np.zeros(0) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(names.astype(np.int64)), pa.array(values)], names=["query_id", "item", "cos"])

        part = own.mapInArrow(best, kinds)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "item")
    return found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
