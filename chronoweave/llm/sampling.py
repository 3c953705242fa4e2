"""Bounded samples of labelled rows, and the fold rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
LABELS = 256


def is_held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves no remainder by 5; a null id counts as its empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def per_label_sample(labelled: DataFrame, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of ``labelled(doc_id, label)`` for each label, by the hash of the id.

    Of more than ``LABELS`` labels the most frequent count, which bounds the sample. Only rows whose hash lies in the lowest share of all hashes that holds about twice as many rows are
    sorted, so that the work doesn't grow with a label's rows. With fewer rows than that all are.
    """
    real = labelled.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select(
        "doc_id", "label", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")).alias("rank")
    )
    counts = real.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS)
    shares = F.broadcast(counts.select("label", (F.lit(2.0 * per_label + 200) / F.col("n")).alias("share")))
    low = real.join(shares, "label").where(F.col("rank") / F.lit(2.0**64) + F.lit(0.5) <= F.col("share"))
    order = Window.partitionBy("label").orderBy("rank", "doc_id")
    return low.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_label).select("doc_id", "label")


def training_rows(docs: DataFrame, labelled: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, text, label) of a sample outside the held-out fold, with distinct ids.

    ``labelled(doc_id, label)``: where an id has several labels the greatest counts. The sample holds
    ``per_label`` rows for each label at most, which bounds what is broadcast and what is returned: of
    rows that share an id the text with the least hash counts, so that a hot id gives one row.
    """
    one = labelled.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = per_label_sample(one, per_label)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~is_held_out(F.col("doc_id")))
    met = texts.join(F.broadcast(chosen), "doc_id")
    least = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("rank"), "text", "label")).alias("row"))
    return least.select("doc_id", "row.text", "row.label")
