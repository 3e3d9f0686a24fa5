"""Token counts from an exact length histogram.

Texts are encoded whole; only their lengths are kept, and aggregated to one row per
distinct length, which is written once. Suffix sums over that histogram answer, for every
context limit, how many documents reach it, how many tokens survive truncation and how
many are lost: each row also names the limits between the next shorter length and its
own, over which these figures are linear in the limit. The sums run in two levels (blocks
of lengths, then the blocks), so that no task reads the whole histogram.

Every row counts, repeated rows too; a null text counts as empty and has no tokens; ids,
which may be null, and other columns take no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_bpe_path, byte_ids, byte_tokenizer, doc_rows, load, stored

BLOCK = 1024


def token_lengths(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the number of its text's tokens; a null text has none."""
    path = tokenizer_path or byte_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_tokenizer(path)
        for b in batches:
            n = np.fromiter((len(byte_ids(encoding, t.as_py())) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """length, n_docs: a row per distinct length."""
    return lengths.groupBy(F.col(col).alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds, for a limit equal to each length: docs and tokens at or above it, tokens kept and lost by truncation, and the share of documents up to it.

    Any limit from limit_from to length truncates the same documents, the docs_at_least
    ones, except those of just that length: it keeps tokens_below + limit * docs_at_least
    tokens. A limit beyond the longest text keeps everything. An empty histogram gives no
    rows. The blocks' own sums, one row per ``block`` lengths, are the only thing that is
    summed in one place.
    """
    h = stored(histogram.select("length", "n_docs"), "histogram").withColumn("blk", F.floor(F.col("length") / block))
    blocks = h.groupBy("blk").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"), F.max("length").alias("longest"))
    falling = Window.orderBy(F.col("blk").desc())
    above = falling.rowsBetween(Window.unboundedPreceding, -1)
    everything = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = blocks.select("blk", zero(F.sum("d").over(above)).alias("docs_above"), zero(F.sum("t").over(above)).alias("tokens_above"), F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"), F.lead("longest").over(falling).alias("shorter"))
    order = Window.partitionBy("blk").orderBy(F.col("length").desc())
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(blocks, "blk").withColumns({"docs_at_least": F.sum("n_docs").over(inside) + F.col("docs_above"), "tokens_at_least": F.sum(F.col("n_docs") * F.col("length")).over(inside) + F.col("tokens_above"), "shorter": F.coalesce(F.lead("length").over(order), "shorter")})
    below = F.col("total_tokens") - F.col("tokens_at_least")
    kept = below + F.col("length") * F.col("docs_at_least")
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    sums = ("length", "n_docs", "docs_at_least", "tokens_at_least", kept.alias("tokens_kept"), (F.col("total_tokens") - kept).alias("tokens_lost"), up_to.alias("docs_up_to"), (up_to / F.col("total_docs")).alias("quantile"))
    return out.select(*sums, "total_docs", "total_tokens", zero(F.col("shorter") + 1).alias("limit_from"), below.alias("tokens_below"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_truncated, tokens_kept, tokens_lost for any limits, from one aggregate over the histogram's rows."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    long = F.col("length") > F.col("limit")
    cut = F.when(long, F.col("limit")).otherwise(F.col("length"))
    per = sums.select("length", "n_docs").withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    out = per.groupBy("limit").agg(F.sum(F.when(long, F.col("n_docs")).otherwise(0)).alias("docs_truncated"), F.sum(cut * F.col("n_docs")).alias("tokens_kept"), F.sum((F.col("length") - cut) * F.col("n_docs")).alias("tokens_lost"))
    return asked.join(out, "limit", "left").na.fill(0)


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least the share q of the documents don't exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(token_lengths(load(spark, sf_dir, "documents"))))
