"""Evaluation metrics over graded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_class(df: DataFrame, gold: str, pred: str, classes: list) -> DataFrame:
    """(class, tp, fp, fn, prec, recall, f1) of each class; what has no cases is 0."""
    counts = df.groupBy(gold, pred).agg(F.count("*").alias("n"))
    table = counts.select(gold, pred, "n", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    is_gold, is_pred = F.col(gold) == F.col("class"), F.col(pred) == F.col("class")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = table.groupBy("class").agg(part(is_gold & is_pred).alias("tp"), part(~is_gold & is_pred).alias("fp"), part(is_gold & ~is_pred).alias("fn"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 6)
    out = out.withColumns({"prec": share("tp", "fp"), "recall": share("tp", "fn")})
    return out.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6))


def calibration(df: DataFrame, score: str, edges: list[float], gold: str, pred: str) -> DataFrame:
    """(bucket, n, accuracy) of the rows between two edges of the score."""
    bucket = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        bucket = F.when(F.col(score) < edges[k], F.lit(k)).otherwise(bucket)
    right = F.avg((F.col(gold) == F.col(pred)).cast("double"))
    return df.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), F.round(right, 6).alias("accuracy"))


def threshold_sweep(df: DataFrame, score: str, gold: str, thresholds: list[float]) -> DataFrame:
    """(threshold, fired, prec): how many rows reach each threshold, and the share of them that are right."""
    each = df.select(score, gold, F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    fired = F.col(score) >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(fired).alias("fired"), F.round(F.avg(F.when(fired, F.col(gold))), 6).alias("prec"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): rows over twice the rows of the label, for two labels; in general over k times."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    joined = counts.crossJoin(F.broadcast(totals))  # totals is one row
    return joined.select(label, F.round(F.col("total") / (F.col("k").cast("double") * F.col("n")), 6).alias("weight"))
