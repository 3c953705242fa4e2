"""Sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON object on each line; blank lines are skipped, a malformed one fails the query."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType | str, labels: list[str] | None = None) -> DataFrame:
    """As ``read_jsonl`` without malformed rows, flagged rows and rows whose label isn't one of ``labels``."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if "flagged" in df.columns:
        df = df.where(~F.coalesce("flagged", F.lit(False)))
    return df.where(F.col("label").isin(labels)) if labels else df


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document; an empty frame if it is missing or corrupt."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        df.limit(1).collect()
        return df
    except Exception as error:  # noqa: BLE001  a missing path is an analysis error of several kinds
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def list_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ts_ms) of the images in a folder, by the number that begins their name; processed ones are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select("path")
    stem = F.regexp_extract("path", r"/(\d+)[^/]*\.jpg$", 1)
    return files.where((stem != "") & ~F.contains("path", F.lit("_processed"))).select("path", stem.cast("long").alias("ts_ms"))


def parse_numstat(lines: DataFrame, position: str = "position", line: str = "value") -> DataFrame:
    """(author, commits, added, deleted) of ``name|email`` lines that are followed by ``added deleted path`` lines.

    ``position`` orders the lines of one file, which the partition column ``file`` tells apart if it exists.
    """
    group = ["file"] if "file" in lines.columns else []
    order = Window.partitionBy(*group).orderBy(position)
    head = F.when(F.contains(line, F.lit("|")) & ~F.contains(line, F.lit("\t")), F.split(line, r"\|")[0])
    parts = F.split(line, "\t")
    number = lambda k: F.coalesce(F.try_to_number(parts[k], F.lit("999999999")).cast("long"), F.lit(0))
    marked = lines.withColumn("author", F.last(head, ignorenulls=True).over(order)).withColumn("head", head.isNotNull())
    is_stat = (F.size(parts) == 3) & ~F.col("head")
    return marked.where(F.col("author").isNotNull()).groupBy("author").agg(
        F.sum(F.col("head").cast("long")).alias("commits"),
        F.coalesce(F.sum(F.when(is_stat & (parts[0] != "-"), number(0))), F.lit(0)).alias("added"),
        F.coalesce(F.sum(F.when(is_stat & (parts[1] != "-"), number(1))), F.lit(0)).alias("deleted"),
    )
