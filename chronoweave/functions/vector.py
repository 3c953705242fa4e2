"""Vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product over the shorter of two vectors."""
    pairs = F.zip_with(doubles(a), doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine with norms over the whole vectors; 0 where either is null, empty or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def cosine_cut(a: str | Column, b: str | Column) -> Column:
    """Cosine after both vectors were cut to the length of the shorter."""
    n = F.least(F.size(doubles(a)), F.size(doubles(b)))
    return cosine(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n))


def half_life(age_days: Column, days: float) -> Column:
    """Weight that halves every ``days`` days; a negative age counts as 0."""
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days, F.lit(0.0)) / F.lit(float(days)))


def mean_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid, fact_count): the element-wise mean of the vectors of each key.

    Sums are taken before the shuffle, a row for each key and element.
    """
    parts = df.select(key, F.posexplode(doubles(vector)).alias("pos", "x"))
    means = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])
    return means.groupBy(key).agg(ordered.alias("centroid"), F.max("n").alias("fact_count"))
