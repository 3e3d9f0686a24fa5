"""What the operators of this subpackage share: tables, the shared folder, tokenizers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.ship import shipped
from mailloom.sources.tables import table

DOC_COLUMNS = ("doc_id", "text")


BATCH_BYTES = "8m"
"""Texts that a Python worker gets at a time; the default of 64 MB is too much beside what is made of them."""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's Arrow batches are limited to BATCH_BYTES from then on."""
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return table(spark, sf_dir, name)


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        folder = "file://" + tempfile.mkdtemp(prefix="mailloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet to the shared folder and read again: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> int:
    """Deletes the tables that this process has written to the shared folder, once nothing that was made from them is needed any more; their number."""
    n = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def crc_remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n: the folds of labelled or training rows. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


@lru_cache(maxsize=4)
def byte_tokenizer(path: str):
    """The byte-level vocabulary as a tiktoken encoding. Its ids equal those of the JSON file of the same vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


LONG_BLANK = 100_000
"""White space from this length on is cut out before the pattern sees it; tiktoken's pattern gives up on runs of a million."""
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_ids(encoding, text: str | None) -> list[int]:
    """A text's ids; a null text has none.

    A run of white space begins a pre-token, and one of two or more is a pre-token but for its last
    character where something but a special token follows (the pattern's look-ahead gives that one back). So the
    text before the run, the run without its last character, and the rest with it are encoded on their own.
    """
    if not text:
        return []
    if len(text) < LONG_BLANK:
        return encoding.encode(text, allowed_special="all")
    out, at, specials = [], 0, tuple(encoding.special_tokens_set)
    for m in _BLANK.finditer(text):
        if m.end() - m.start() >= LONG_BLANK:
            ends = m.end() == len(text) or text.startswith(specials, m.end())
            cut = m.end() - (not ends)
            out += encoding.encode(text[at : m.start()], allowed_special="all")
            out += encoding._encode_single_piece(text[m.start() : cut])  # one pre-token: no pattern
            at = cut
    return out + encoding.encode(text[at:], allowed_special="all")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def with_columns(df: DataFrame, text_col: str, fields: dict[str, tuple[pa.DataType, str]], compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The same rows and columns, and new ones that a function makes from a batch of texts, in the order of fields (name: Arrow type, DDL type)."""
    names, at = df.columns, df.columns.index(text_col)
    if taken := {n.lower() for n in names} & {n.lower() for n in fields}:
        raise ValueError(f"columns are there already: {sorted(taken)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x.cast(kind) if x.type != kind else x for x, (kind, _) in zip(compute(b.column(at)), fields.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*names, *fields])

    schema = T.StructType([*df.schema.fields, *(f for name, (_, ddl) in fields.items() for f in T.StructType.fromDDL(f"`{name}` {ddl}").fields)])
    return df.mapInArrow(run, schema)


def labelled_sample(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id and label of at most so many labelled ids, chosen by a hash of the id: the bound that lets it be broadcast."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    one = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)


def merge_tree(parts: DataFrame, combine: Callable[[list[bytes]], bytes], fan: int = 32, levels: int = 3) -> list[tuple[int, bytes]]:
    """Merges what tasks have made - rows (task int, part int, data binary), of a fixed size each - to one row per part, in a tree, and gives these few to the driver."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [key[1]], "part": [key[0]], "data": [combine(list(pdf["data"]))]})

    level = parts.select("task", "part", "data")
    for _ in range(levels):
        level = level.withColumn("task", F.floor(F.col("task") / fan).cast("int")).groupBy("part", "task").applyInPandas(run, "task int, part int, data binary")
    found: dict[int, list[bytes]] = {}
    for r in level.select("part", "data").toLocalIterator():
        found.setdefault(r[0], []).append(r[1])
    return [(part, combine(data)) for part, data in sorted(found.items())]
