"""Language of texts by character n-grams: a multinomial model whose tables are learned from labelled texts.

A text's n-grams are those of its first characters, in lower case, white space as single blanks. The
probability of an n-gram in a language is its share there, one added to each count; weights are
logarithms in whole steps of 2^-20, so that their sums don't depend on any order. Texts are scored in Arrow
batches: their n-grams meet the table, whose size is bounded, and a text's sums are formed where it was read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.functions.features import LANGUAGE_CHARS, LANGUAGE_LEAST
from mailloom.functions.text import strip, text
from mailloom.sources.shared import stored

N, MOST_GRAMS, MOST_LANGUAGES = 3, 50_000, 200
STEP = 1 << 20


def chars(c: Column) -> Column:
    """A text's first characters, with a blank before and after."""
    plain = F.regexp_replace(F.lower(F.substring(strip(text(c)), 1, LANGUAGE_CHARS)), r"(?U)\s+", " ")
    return F.split(F.concat(F.lit(" "), plain, F.lit(" ")), "")


def grams(lists: pa.ListArray, n: int) -> tuple[pa.Array, np.ndarray]:
    """The n-grams of rows of characters, and the row of each; fewer than n characters are one."""
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    m = len(flat) - n + 1
    own = row[:m] == row[n - 1 :] if m > 0 else np.zeros(0, bool)
    term = pc.binary_join_element_wise(*(flat.slice(k, m) for k in range(n)), "").filter(pa.array(own)) if m > 0 else flat.slice(0, 0)
    short = np.flatnonzero(pc.fill_null(pc.less(pc.list_value_length(lists), n), False).to_numpy(zero_copy_only=False))
    whole = pa.array(["".join(x) for x in lists.take(pa.array(short)).to_pylist()], pa.string())
    return pa.concat_arrays([term, whole]), np.concatenate([row[: max(m, 0)][own], short])


@dataclass
class LanguageModel:
    """languages in order; table: gram, w (how much more it weighs in each language than an unseen one); unseen: an unseen one's weights."""

    languages: list[str]
    table: DataFrame
    unseen: list[int]
    n: int = N

    def save(self, path: str) -> None:
        rows = self.table.withColumns({"languages": F.array(*map(F.lit, self.languages)), "unseen": F.array(*(F.lit(x).cast("long") for x in self.unseen)), "n": F.lit(self.n)})
        rows.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanguageModel:
        rows = spark.read.parquet(path)
        first = rows.select("languages", "unseen", "n").first()
        return cls(list(first["languages"]), rows.select("gram", "w"), list(first["unseen"]), first["n"])


def fit(df: DataFrame, body: str = "text", language: str = "lang", n: int = N, most: int = MOST_GRAMS) -> LanguageModel:
    """Learned from rows with a language; of the n-grams the most frequent, ties in their order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            term, row = grams(b.column(1), n)
            t = pa.table({"lang": b.column(0).take(pa.array(row)), "gram": term, "c": pa.array(np.ones(len(term), np.int64))})
            t = t.group_by(["lang", "gram"], use_threads=False).aggregate([("c", "sum")]).select(["lang", "gram", "c_sum"]).rename_columns(["lang", "gram", "c"])
            yield from t.to_batches()

    rows = df.filter(F.col(language).isNotNull()).select(F.col(language).cast("string").alias("lang"), chars(F.col(body)).alias("chars"))
    made = rows.mapInArrow(run, "lang string, gram string, c long")
    counts = stored(made.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")  # four jobs read it
    kept = counts.groupBy("gram").agg(F.sum("c").alias("c")).orderBy(F.col("c").desc(), "gram").limit(most).select("gram")
    counts = counts.join(kept, "gram")
    total = {r["lang"]: r["c"] for r in counts.groupBy("lang").agg(F.sum("c").alias("c")).collect()}
    if not total or len(total) > MOST_LANGUAGES:
        raise ValueError(f"{len(total)} languages to learn from")
    names, v = sorted(total), counts.select("gram").distinct().count()
    weight = lambda c, lang: F.round(F.log((c + 1.0) / F.lit(float(total[lang] + v + 1))) * STEP).cast("long")
    none = df.sparkSession.range(1).select(*(weight(F.lit(0.0), x).alias(f"u{k}") for k, x in enumerate(names))).first()
    by = counts.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == x, F.col("c")).otherwise(0)).alias(f"c{k}") for k, x in enumerate(names)))
    table = by.select("gram", F.array(*(weight(F.col(f"c{k}"), x) - none[k] for k, x in enumerate(names))).alias("w"))
    return LanguageModel(names, table, list(none), n)


def detect(df: DataFrame, model: LanguageModel, body: str = "text", keys: tuple[str, ...] = ("doc_id",), out: str = "language") -> DataFrame:
    """keys and the language of each text; unknown for one of fewer than 15 characters. Rows that repeat a key count as one text; of equal sums the first language wins."""
    long = F.length(strip(text(F.col(body)))) >= LANGUAGE_LEAST
    names, found = [f"s{k}" for k in range(len(model.languages))], model.table.toArrow()  # bounded: see MOST_GRAMS
    known = found["gram"].combine_chunks()
    weights = np.array(found["w"].to_pylist() + [[0] * len(names)], np.int64).reshape(-1, len(names))  # the last row is an unseen one's
    shared, size, at = df.sparkSession.sparkContext.broadcast((known, weights)), model.n, len(keys)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_, w = shared.value
        for b in parts:
            term, row = grams(b.column(at), size)
            place = pc.fill_null(pc.index_in(term, value_set=grams_), len(grams_)).to_numpy(zero_copy_only=False)
            sums = np.zeros((b.num_rows, w.shape[1]), np.int64)
            order = np.argsort(row, kind="stable")
            if len(order):
                r = row[order]
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                sums[r[first]] = np.add.reduceat(w[place[order]], first, axis=0)
            n = np.bincount(row, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(n), *(pa.array(np.ascontiguousarray(x)) for x in sums.T)], [*keys, "n", *names])

    rows = df.select(*keys, F.when(long, chars(F.col(body))).alias("__chars"))
    made = rows.mapInArrow(run, T.StructType([*(rows.schema[k] for k in keys), T.StructField("n", T.LongType()), *(T.StructField(x, T.LongType()) for x in names)]))
    scored = made.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(F.col(x) + F.col("n") * F.lit(u)).alias(x) for x, u in zip(names, model.unseen, strict=True)))
    sums = names
    top = F.greatest(*(F.col(f"s{k}") for k in range(len(sums)))) if len(sums) > 1 else F.col("s0")
    pick = F.lit(None).cast("string")
    for k, name in reversed(list(enumerate(model.languages))):
        pick = F.when(F.col(f"s{k}") == top, F.lit(name)).otherwise(pick)
    return scored.select(*keys, F.when(F.col("n") == 0, "unknown").otherwise(pick).alias(out))
