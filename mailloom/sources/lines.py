"""Records of large text files, read in splits and numbered as one pass would number them.

Spark's text reader cuts files into byte ranges, and a range begins with the first record after
its start, whatever separates records; so one file is read by many tasks. A record's place in its file is its
place in the range plus the records of the ranges before it. The ranges are counted in a pass
of their own; what is joined to the records is a row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, separator: str = "\n", glob: str | None = None, keep: Callable[[Column], Column] | None = None, opening: str = "") -> DataFrame:
    """path, place, last, headed, value of all records of files below a path; place counts from 0 in each file, last marks its last record, headed files that begin with ``opening``.

    ``keep`` is a condition on the file's name; files that it leaves out are not opened. A
    separator at the end of a file begins no record. Paths are as the reader gives them, with
    special characters in their encoded form. Both passes list the files; should they
    change in between, the read fails.
    """
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.text(path)
    if keep is not None:
        found = found.filter(keep(F.col("_metadata.file_name")))
    # within a task records are numbered in the order of reading, and those of a range come together
    rows = found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("row"), "value")
    ranges = rows.groupBy("path", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.min_by(F.col("value").startswith(opening), "row").alias("headed"))
    upto = Window.partitionBy("path").orderBy("range")
    ranges = ranges.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("path")), "headed": F.first("headed").over(upto)})
    inside = F.col("row") - F.col("first")
    inside = F.when(inside.between(0, F.col("n") - 1), inside).otherwise(F.raise_error(F.lit("files have changed while they were read")).cast("long"))
    place = F.col("before") + inside
    return rows.join(ranges, ["path", "range"]).select("path", place.alias("place"), (place == F.col("total") - 1).alias("last"), "headed", "value")
