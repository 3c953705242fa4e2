"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.staging import Staging


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return out.where("hi != lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, staging: Staging) -> DataFrame:
    """(node, root) for each node of the undirected ``edges(a, b)``; root is the least node reachable.

    Alternates the two star steps of Kiveris et al., "Connected Components in MapReduce and Beyond"
    (2014), until the edges no longer change. Each round is a staged table, so that neither lineage
    nor a lost executor repeats earlier rounds. Loops and repeated edges are allowed; nodes without
    an edge don't appear.
    """
    start = edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    current = staging.write(start, "edges-0")
    state = None
    turn = 0
    while True:
        row = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo") % (1 << 31)).alias("h")).first()
        if (row.n, row.h) == state or row.n == 0:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
                current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        state = (row.n, row.h)
        turn += 1
        after = staging.write(_small_star(_large_star(current)), f"edges-{turn}")
        staging.drop(f"edges-{turn - 1}")
        current = after
