"""Exact duplicates: the first row of each key stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in a total order; a window over (key, order) is planned with a group limit, so that one very common key leaves each task as one row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == 1).drop("__n")


def by_fingerprint(df: DataFrame, subject: str = "subject", body: str = "body", source: str = "source", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per source, the first of all messages with one subject and body."""
    from mailloom.functions.features import fingerprint

    keyed = df.withColumn("__fp", fingerprint(F.col(subject), F.col(body)))
    return first_of_each(keyed, [source, "__fp"], list(order)).drop("__fp")


def by_file_name(files: DataFrame, path: str = "path", key: str = "md5") -> DataFrame:
    """One file for each name: by the digest that ends it, or (``stem``) by what stands before it."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    part = F.element_at(F.split(name, r"\."), -1) if key == "md5" else F.regexp_replace(name, r"\.[^.]*\z", "")
    return first_of_each(files.withColumn("__key", part), ["__key"], [path]).drop("__key")
