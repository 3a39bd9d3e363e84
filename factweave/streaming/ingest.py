"""Incremental variants on Structured Streaming.

They carry the set operators over to streams: new documents by content, the last
delivery of a record, counts by event-time window. A batch of a stream goes through
the same functions as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.store import upsert


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def first_contents(documents: DataFrame, text: str, at: str, within: str = "1 day") -> DataFrame:
    """Documents whose content was not seen before; state is kept for ``within`` of event time ``at``."""
    return documents.withColumn("hash", F.sha2(text, 256)).withWatermark(at, within).dropDuplicatesWithinWatermark(["hash"])


def window_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; those later than ``late`` are left out."""
    w = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), by, "n")


def upsert_into(path: str, keys: list[str]):
    """A ``foreachBatch`` function that upserts each batch into a table in the folder ``path``.

    Batches are written as versions ``path/v=<batch>``; a batch that is run again
    writes the same version, so that a restart neither loses nor doubles rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = f"{path}/v={number - 1}"
        old = spark.read.parquet(before) if number and fs.exists(jvm.org.apache.hadoop.fs.Path(before)) else batch.limit(0)
        upsert(old, batch, keys).write.mode("overwrite").parquet(f"{path}/v={number}")

    return run
