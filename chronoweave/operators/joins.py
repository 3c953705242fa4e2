"""Joins on time and similarity that have no operator of their own in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.sessions import seconds_between


def asof_backward(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, name: str) -> DataFrame:
    """``left`` with the ``value`` of the latest row of ``right`` with the same key at or before its instant, or null.

    One shuffle by key: both sides are sorted together and the last value is carried on.
    """
    columns = left.columns
    sides = left.withColumn("side", F.lit(1)).withColumn(name, F.lit(None).cast(right.schema[value].dataType))
    others = right.select(key, ts, F.lit(0).alias("side"), F.col(value).alias(name))
    order = Window.partitionBy(key).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    both = sides.unionByName(others, allowMissingColumns=True)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(order)).where("side = 1").select(*columns, name)


def range_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, before_s: int, after_s: int, bucket_s: int | None = None) -> DataFrame:
    """Pairs with ``right_ts`` between ``before_s`` seconds before and ``after_s`` after ``left_ts``, bounds included.

    The right side goes to its bucket, the left to those that its window touches, so that the join is
    an equi-join on buckets instead of a nested loop.
    """
    width = bucket_s or max(1, before_s + after_s)
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    spots = F.sequence(F.floor((second(left_ts) - before_s) / width), F.floor((second(left_ts) + after_s) / width))
    a = left.withColumn("bucket", F.explode(spots))
    b = right.withColumn("bucket", F.floor(second(right_ts) / width))
    delta = seconds_between(F.col(right_ts), F.col(left_ts))
    return a.join(b, "bucket").withColumn("delta_s", delta).where(F.col("delta_s").between(-before_s, after_s)).drop("bucket")


def nearest(left: DataFrame, right: DataFrame, left_id: str, left_ts: str, right_id: str, right_ts: str, tolerance_s: int) -> DataFrame:
    """For each left id the nearest right row within the tolerance; ties to the smaller right id, null last. Ids without one go.

    Only the last right row at or before an instant and the first one after it can be nearest, so no pairs within the tolerance are made: both are
    carried along the rows of a bucket of time as wide as the tolerance, to which its neighbours give their last and first right row.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width, no_row = max(1, tolerance_s) * 1_000_000, f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in right.schema)}>"
    ordered = F.struct(F.col(right_id).isNull().alias("none_"), F.col(right_id).alias("id_"))
    rows = right.where(F.col(right_ts).isNotNull()).groupBy(micros(right_ts).alias("at_")).agg(F.min_by(F.struct(*right.columns), ordered).alias("row_"))
    rows = rows.withColumn("bucket_", F.floor(F.col("at_") / width))
    ends = rows.groupBy("bucket_").agg(F.struct(F.min("at_").alias("at_"), F.min_by("row_", "at_").alias("row_")).alias("first"), F.struct(F.max("at_").alias("at_"), F.max_by("row_", "at_").alias("row_")).alias("last"))
    lent = [ends.select(f"{end}.at_", f"{end}.row_", (F.col("bucket_") + step).alias("bucket_")) for end, step in (("first", -1), ("last", 1))]
    known = rows.unionByName(lent[0]).unionByName(lent[1]).withColumns({"side_": F.lit(0), "own_": F.lit(None).cast(f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in left.schema)}>")})
    asked = left.where(F.col(left_ts).isNotNull()).select(micros(left_ts).alias("at_"), F.lit(None).cast(no_row).alias("row_"), F.floor(micros(left_ts) / width).alias("bucket_"), F.lit(1).alias("side_"), F.struct(*left.columns).alias("own_"))
    spot = F.when(F.col("side_") == 0, F.struct("at_", "row_"))
    past, next_ = (Window.partitionBy("bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("at_", "side_"), (F.desc("at_"), "side_")))
    both = known.unionByName(asked).withColumn("past_", F.last(spot, ignorenulls=True).over(past)).withColumn("next_", F.last(spot, ignorenulls=True).over(next_))
    near = both.where("side_ = 1").select("own_", "at_", F.explode(F.array("past_", "next_")).alias("met_")).withColumn("far_", F.abs(F.col("met_.at_") - F.col("at_")))
    order = Window.partitionBy(f"own_.{left_id}").orderBy("far_", F.asc_nulls_last(f"met_.row_.{right_id}"))
    first = near.where(F.col("far_") <= tolerance_s * 1_000_000).withColumn("place_", F.row_number().over(order)).where("place_ = 1")
    out = first.select("own_.*", "met_.row_.*")
    return out.withColumn("delta_s", seconds_between(F.col(right_ts), F.col(left_ts)))


def previous_k(df: DataFrame, key: str, ts: str, item: str, k: int) -> DataFrame:
    """``df`` with previous, the ``k`` items of the key just before the row, oldest first."""
    order = Window.partitionBy(key).orderBy(ts, item).rowsBetween(-k, -1)
    return df.withColumn("previous", F.collect_list(item).over(order))


def gated_facts(facts: DataFrame, clusters: DataFrame, query: DataFrame, gate: float, least: float, k: int) -> DataFrame:
    """The k facts nearest to the one vector of ``query(q)``, by two stages.

    Only facts of clusters whose centroid has at least the cosine ``gate`` are scored; then those with
    ``least`` or more stay. A cluster without centroid passes.
    """
    from chronoweave.functions.vector import cosine

    near = clusters.crossJoin(F.broadcast(query)).withColumn("gate", cosine("centroid", "q"))
    passed = near.where(F.col("centroid").isNull() | (F.col("gate") >= gate)).select("cluster_id", "gate")
    scored = facts.join(passed, "cluster_id").crossJoin(F.broadcast(query)).withColumn("score", cosine("embedding", "q"))
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "fact_id").limit(k)
