"""Sinks: routed JSON lines, resumable output, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "append", keep_nulls: bool = False) -> int:
    """One JSON object a line; null fields are left out unless they are kept. The number of rows, counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", not keep_nulls).json(path)
    return int(seen.get["n"])


def write_by_label(df: DataFrame, path: str, mode: str = "append") -> None:
    """A folder for each label. With ``overwrite`` only the folders that get rows are replaced, so that a rerun does no harm."""
    rows = df.withColumn("route", F.col("label"))
    w = rows.write.option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", True)
    w.mode(mode).partitionBy("route").json(path)


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that the output does not have yet, by key and not by position."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    """A few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
