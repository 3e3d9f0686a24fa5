"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = "8m"
"""Texts that a Python worker gets at a time; batches of 10,000 rows, whatever their size, would let its memory grow with the texts."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, spread over all cores if its files split into fewer tasks than there are cores.

    A small file is often one row group, that is one task, however heavy the work on its
    rows is. Arrow batches of the session are limited from then on. Tables of a size that matters split into more tasks than that and are not shuffled.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
