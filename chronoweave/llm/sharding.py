"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.staging import Staging

SHARDS = 24
VIRTUAL_NODES = 64
SUB_ARCS = 32
_TOP = 1 << 63


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise; positions are signed 64-bit."""
    nodes = ((xxhash.xxh64_intdigest(f"shard-{s}-node-{v}") - _TOP, s) for s in range(shards) for v in range(virtual_nodes))
    return sorted(nodes)


def plan(counts: list[list[int]], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first, last, shard, slot) of the arcs' keys, which have numbers from 0 within their arc.

    ``counts[a]`` is the number of keys in arc a, all of whose keys meet the node of shard ``owners[a]``
    first. Every shard takes its own arcs' keys clockwise until it is full; keys that it can't take
    continue clockwise to the next node whose shard has room. ``slot`` is the piece's first place in
    its shard. The work depends on the number of arcs alone.
    """
    room, filled, pieces, over = list(capacity), [0] * len(capacity), [], []

    def give(arc: int, first: int, n: int, shard: int) -> None:
        if n:
            pieces.append((arc, first, first + n - 1, shard, filled[shard]))
            filled[shard] += n
            room[shard] -= n

    for arc, n in enumerate(counts):
        taken = min(n, room[owners[arc]])
        give(arc, 0, taken, owners[arc])
        if taken < n:
            over.append((arc, taken, n - taken))
    for arc, first, n in over:
        step = arc
        while n:
            step = (step + 1) % len(owners)
            taken = min(n, room[owners[step]])
            give(arc, first, taken, owners[step])
            first, n = first + taken, n - taken
    return pieces


def arc_of(nodes: list[tuple[int, int]]):
    """A function that gives the number of the first node at or after each position, clockwise."""
    positions = np.array([p for p, _ in nodes], np.int64)

    @F.pandas_udf("int")
    def search(at: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(positions, at.to_numpy(np.int64)) % len(positions)).astype(np.int32))

    return search


def shard(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs(doc_id, text)``.

    A row's place on the ring is the hash of its doc_id (a null id has a place as well). A shard's
    bound is its equal share of the rows, so that the shards' row counts are at most one apart (law
    ``rows``); rows that a full shard can't take continue clockwise. Slots count from 0 within a shard
    without gaps. The order within an arc is that of hashes of the whole row, so the result depends
    on the rows alone. size is the text's bytes plus 8, null having none; grown_shard is null. An
    empty table gives no row; equal rows get different slots.

    Only counts by arc and sub-arc come to the driver: shards x virtual_nodes x 32 numbers at most.
    """
    nodes = ring(shards, virtual_nodes)
    staging = Staging(docs.sparkSession, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.xxhash64(F.col("doc_id").cast("string"))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        arc_of(nodes)(place).alias("arc"),
    )
    whole = F.xxhash64(F.col("doc_id").cast("string"), F.col("size"), F.col("text_crc32"))
    rows = staging.write(slim.withColumn("whole", whole).withColumn("sub", F.pmod(F.shiftright("whole", 40), F.lit(SUB_ARCS)).cast("int")), "rows")
    counted = {(x.arc, x.sub): x["count"] for x in rows.groupBy("arc", "sub").count().collect()}
    total = sum(counted.values())
    starts, sums = [], []
    for arc in range(len(nodes)):
        n = 0
        for sub in range(SUB_ARCS):
            if (arc, sub) in counted:
                starts.append((arc, sub, n))
                n += counted[arc, sub]
        sums.append(n)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    spark = docs.sparkSession
    pieces = spark.createDataFrame(plan(sums, [s for _, s in nodes], capacity), "arc int, first long, last long, shard int, base long")
    offsets = spark.createDataFrame(starts, "arc int, sub int, before long")
    number = F.row_number().over(Window.partitionBy("arc", "sub").orderBy("whole", "doc_id", "size")) - 1
    numbered = rows.withColumn("number", number).join(F.broadcast(offsets), ["arc", "sub"]).withColumn("number", F.col("number") + F.col("before"))
    return numbered.join(F.broadcast(pieces), "arc").where(F.col("number").between(F.col("first"), F.col("last"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("base") + F.col("number") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
