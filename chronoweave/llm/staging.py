"""Tables written between the steps of an operator.

They cut lineage and survive the loss of executors: every table lies in the folder that the
cluster names in ``spark.checkpoint.dir``, which the driver and all executors share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="chronoweave-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


class Staging:
    """The staged tables of one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        # A batch of texts given to Python has to fit in a worker's memory even when all are long.
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    @contextmanager
    def batches(self, rows: int) -> Iterator[None]:
        """For what is written meanwhile, batches for Python have ``rows`` rows; for short rows only."""
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(rows))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table as read again."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a staged table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
