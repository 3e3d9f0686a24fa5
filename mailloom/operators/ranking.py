"""Ranks and running sums in large groups: blocks of the order first, then within blocks.

A window over a few groups would sort each of them in one task. Here every row has a
block that follows the order; the blocks are counted, a window over these counts gives
each block's offset, and only the rows of one block are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], block: Column, order: list[Column | str], rank: str = "__n", total: str = "__total") -> DataFrame:
    """Adds each row's rank in its group, from 1, and the group's size. ``block`` is a number that never falls along the order."""
    b = df.withColumns({"__g": F.xxhash64(F.lit(0), *group), "__b": block.cast("long")})
    counts = b.groupBy("__g", "__b").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy("__g").orderBy("__b"))
    offsets = counts.select("__g", "__b", (upto - F.col("__c")).alias("__o"), F.sum("__c").over(Window.partitionBy("__g")).alias(total))
    inside = F.row_number().over(Window.partitionBy("__g", "__b").orderBy(*order))
    return b.join(offsets, ["__g", "__b"]).withColumn(rank, F.col("__o") + inside).drop("__g", "__b", "__o")


def md5_block(digest: Column) -> Column:
    """One of 4096 blocks in the order of an md5."""
    return F.conv(F.substring(digest, 1, 3), 16, 10)
