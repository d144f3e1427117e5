"""Sinks of streams that may stop at any point and start again from their checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BATCH = "batch_id"


def keyed_writer(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """Writer of one folder for each micro-batch, named by its id.

    A micro-batch that ran before the stop and runs again replaces its own folder, so nothing is there twice. ``change``
    works on the rows of each micro-batch as on a table. A folder is read only when it is complete.
    """

    def write(rows: DataFrame, batch: int) -> None:
        out = rows if change is None else change(rows)
        out.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def read_keyed(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of a keyed sink without the batch id. Folders without the mark of a finished write are left out; the
    micro-batch they belong to runs again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    if fs.exists(where):  # one folder for each micro-batch
        done = [f.getPath().toString() for f in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*done)


def batch_counts(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of each micro-batch of a keyed sink."""
    id_ = F.regexp_extract(F.col("_metadata.file_path"), f"{BATCH}=(\\d+)/", 1).cast("long")
    return read_keyed(spark, path, schema).groupBy(id_.alias(BATCH)).agg(F.count(F.lit(1)).alias("rows"))
