"""Tables, and the logical views over them that the retrieval and memory operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.sessions import gap_sessions

#: The instant that counts as now, as results must not depend on when they are computed.
NOW = "2024-01-31 00:00:00"
INTERESTING = 20.0


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the application they come from, the number in their payload and whether they are interesting."""
    return load(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.concat(F.lit("app"), (F.col("user_id") % 10).cast("string")).alias("process_name"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("value") >= INTERESTING).alias("interesting"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user: events with no gap over 30 minutes."""
    return gap_sessions(load(spark, folder, "events"), "user_id", "ts", 1800)


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Memory clusters: the labels of the embeddings, with centroid and number of facts."""
    from chronoweave.functions.vector import mean_vector

    return mean_vector(load(spark, folder, "embeddings"), "label", "embedding").withColumnRenamed("label", "cluster_id")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Memory facts: the embeddings, valid from an hour that their id gives; those of label 0 to 2 ended after ten days."""
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=(F.col("vec_id") % 700).cast("int"))
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("fact_id"),
        F.col("label").alias("cluster_id"),
        "embedding",
        start.alias("valid_from"),
        F.when(F.col("label") <= 2, start + F.make_interval(days=F.lit(10))).alias("valid_to"),
        F.when(F.col("label") % 2 == 0, "distiller").otherwise("agent").alias("source"),
    )
