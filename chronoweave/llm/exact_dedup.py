"""Exact dedup with a heavy-hitter split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.staging import Staging

COUNTERS = 1024
HEAVY = 64
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def without_white_space(text: Column) -> Column:
    """``text`` without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for char in _WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def _summary(counters: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Misra-Gries over one partition: at most ``counters`` digests with lower bounds of their counts."""
    held = pd.Series(dtype="int64")
    for batch in batches:
        held = held.add(batch["digest"].value_counts(), fill_value=0)
        if len(held) > counters:
            held = held - held.nlargest(counters + 1).iloc[-1]
            held = held[held > 0]
    if len(held):
        yield pd.DataFrame({"digest": held.index.to_list(), "n": held.to_numpy("int64")})


def frequent(rows: DataFrame, counters: int) -> list[bytes]:
    """At most ``counters`` digests, among them each with more than 1 / (counters + 1) of all rows.

    The partitions' summaries merge by adding counts and then subtracting the count of rank
    ``counters + 1`` (Agarwal et al., "Mergeable Summaries", 2012).
    """
    parts = rows.select("digest").mapInPandas(lambda x: _summary(counters, x), "digest binary, n long")
    top = parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    floor = top[-1].n if len(top) > counters else 0
    return [bytes(x.digest) for x in top if x.n > floor]


def decide(docs: DataFrame, counters: int = COUNTERS, heavy: int = HEAVY, staging: Staging | None = None) -> DataFrame:
    """For each row of ``docs(doc_id, text)`` the row that stays of its group of equal texts.

    Texts are equal when identical without white space (``[\\x20\\x09-\\x0D]``), null being empty. Of a
    group, the row with the most code points stays, then the one with the smallest doc_id (nulls
    last); of wholly repeated rows one stays. Returns row, doc_id, n_points, digest (SHA-256 of the
    normalised text), keep_id, group_size and kept, a row for each row; an empty table gives none.

    Digests that Misra-Gries finds frequent are counted exactly, and those with ``heavy`` rows or more
    are resolved where the rows lie, by broadcasting at most ``counters`` winners; only the others
    are shuffled, and none of those has more than 1 / (counters + 1) of all rows or ``heavy`` rows.
    """
    staging = staging or Staging(docs.sparkSession, "exact")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staging.write(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.length(text).alias("n_points"),
            F.unhex(F.sha2(without_white_space(F.col("text")).cast("binary"), 256)).alias("digest"),
        ),
        "rows",
    )
    order = F.struct(
        (-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")
    )
    spark = docs.sparkSession
    candidates = spark.createDataFrame([(x,) for x in frequent(rows, counters)], "digest binary")
    found = (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        .where(F.col("group_size") >= heavy)
        .collect()
    )
    winners = spark.createDataFrame(
        [(bytes(x.digest), x.group_size, x.best.doc_id, x.best.row) for x in found],
        "digest binary, size long, best_id {0}, best_row long".format(docs.schema["doc_id"].dataType.simpleString()),
    )
    marked = rows.join(F.broadcast(winners), "digest", "left")
    columns = ["row", "doc_id", "n_points", "digest"]
    settled = marked.where("size is not null").select(
        *columns, F.col("best_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best_row")).alias("kept")
    )
    group = Window.partitionBy("digest")
    rest = (
        marked.where("size is null")
        .select(*columns, F.min(order).over(group).alias("best"), F.count("*").over(group).alias("group_size"))
        .select(*columns, F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))
    )
    return settled.unionByName(rest)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps, with their columns as they are.

    Rows meet their decision by doc_id and digest; where several rows share both, one of them stays.
    """
    decided = decide(docs)
    group = ["doc_id", "digest", "n_points"]
    stays = decided.where("kept").select(
        F.col("doc_id").alias("stay_id"), F.col("digest").alias("stay_digest"), F.col("n_points").alias("stay_points")
    )
    key = F.unhex(F.sha2(without_white_space(F.col("text")).cast("binary"), 256))
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    named = named.select("doc", "doc_id", key.alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"))
    met = named.join(
        stays,
        F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest")) & (F.col("n_points") == F.col("stay_points")),
        "left_semi",
    )
    # Only where an id repeats among rows that stay can one decision meet several rows.
    repeated = decided.groupBy(group).agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("kept and n > 1")
    if repeated.isEmpty():
        return met.select("doc.*")
    again = repeated.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), F.lit(True).alias("again"))
    flagged = met.join(again, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    single = flagged.where("again is null").select("doc.*")
    several = flagged.where("again").dropDuplicates(["doc_id", "digest"]).select("doc.*")
    return single.unionByName(several)
