"""Samples, splits, quotas, seed pools and their provenance."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailloom.functions.features import model_hash

from .ranking import md5_block, ranked


def hash_order(seed: int, key: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample_per_group(df: DataFrame, group: str, k: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """k rows of each group, by the order of a seeded hash; all, if it has fewer."""
    h = hash_order(seed, key)
    return ranked(df, [group], md5_block(h), [h, key]).filter(F.col("__n") <= k).drop("__n", "__total")


def stratified_split(df: DataFrame, group: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Adds split: train, val or test, with the ratios in every group."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    n, i = F.col("__total"), F.col("__n") - 1
    train, val = F.floor(n * ratios[0]), F.floor(n * ratios[1])
    h = hash_order(seed, key)
    out = ranked(df, [group], md5_block(h), [h, key])
    return out.withColumn("split", F.when(i < train, "train").when(i < train + val, "val").otherwise("test")).drop("__n", "__total")


def exact_sample(n: int, k: int, seed: int) -> list[int]:
    """Row positions as Python's generator draws them without replacement; all, in order, if there are no more than k."""
    return random.Random(seed).sample(range(n), k) if k < n else list(range(n))


def quotas(total: int, models: list[str], remainder: bool = True) -> dict[str, int]:
    """Equal shares; the first ones take the rest. Without ``remainder`` nobody does, as in older tracers, whose pools then lack the last seeds of the first models."""
    share, rest = divmod(total, len(models))
    return {m: share + (remainder and i < rest) for i, m in enumerate(models)}


def quota_column(total: int, models: DataFrame, order: str = "model") -> DataFrame:
    """model, quota on built-in functions."""
    rank = F.row_number().over(Window.orderBy(order))
    n = F.count("*").over(Window.partitionBy())
    share = F.floor(F.lit(total) / n)
    return models.select(order, (share + F.when(rank <= F.lit(total) % n, 1).otherwise(0)).cast("long").alias("quota"))


BUFFER = 0.5
"""The share by which a pool is longer than its quota."""


def pool_positions(n_seeds: int, quota: int, model: str, seed: int = 42, buffer: float = BUFFER) -> list[int]:
    """Positions of a model's seeds, drawn with replacement; a longer pool begins with a shorter one."""
    rng = random.Random(seed + model_hash(model))
    return rng.choices(range(n_seeds), k=int(quota * (1 + buffer))) if n_seeds else []


def seed_pool(spark: SparkSession, seeds: DataFrame, n_seeds: int, models: dict[str, int], seed: int = 42, buffer: float = BUFFER, position: str = "position") -> DataFrame:
    """model, seed_idx and the seed's columns: drawn positions joined to the seeds."""
    drawn = [(m, i, p) for m, quota in models.items() for i, p in enumerate(pool_positions(n_seeds, quota, m, seed, buffer))]
    return spark.createDataFrame(drawn, f"model string, seed_idx int, {position} int").join(seeds, position)


def check_traceable(generated: DataFrame, lengths: dict[str, int], model: str = "source", index: str = "seed_idx") -> None:
    """Fails, with the models' counts, if a row's index isn't within its model's pool."""
    pools = generated.sparkSession.createDataFrame([(m, int(n)) for m, n in lengths.items()], "__model string, __length long")
    rows = generated.join(pools, F.col(model) == F.col("__model"), "left")
    inside = F.coalesce(F.col(index).between(0, F.col("__length") - 1), F.lit(False))
    bad = rows.filter(~inside).groupBy(model).agg(F.count("*").alias("n"), F.max(index).alias("most")).collect()
    if bad:
        raise ValueError("rows without a seed: " + ", ".join(f"{r[0]}: {r['n']} (largest index {r['most']}, pool of {lengths.get(r[0], 0)})" for r in bad))


def trace(generated: DataFrame, pool: DataFrame) -> DataFrame:
    """Generated rows with the seed that each came from; rows out of the pool's range are left out: see :func:`check_traceable`."""
    return generated.join(pool, [generated["source"] == pool["model"], generated["seed_idx"] == pool["seed_idx"]]).drop(pool["model"]).drop(pool["seed_idx"])


def not_done(pool: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return pool.join(done.select(*keys), keys, "left_anti")


def resume_at(done: DataFrame, batch: int, model: str = "model") -> DataFrame:
    """model, position: where generation goes on, the start of the batch after the last one begun."""
    return done.groupBy(model).agg(((F.floor(F.max("seed_idx") / batch) + 1) * batch).alias("position"))


def whole_batches(rows: DataFrame, batch: int, keys: list[str], index: str = "seed_idx", ok: str = "is_valid") -> DataFrame:
    """Only rows of batches in which every row is valid."""
    b = rows.withColumn("__b", F.floor(F.col(index) / batch))
    good = b.groupBy(*keys, "__b").agg(F.min(F.col(ok).cast("int")).alias("__ok")).filter(F.col("__ok") == 1).drop("__ok")
    return b.join(good, [*keys, "__b"], "left_semi").drop("__b")


def seed_blocks(rows: DataFrame, batch: int, index: str = "n", body_chars: int = 1500) -> DataFrame:
    """batch, prompt: numbered blocks of subject and body, joined in order; a batch is bounded by its size."""
    from mailloom.functions.text import strip, text

    r = rows.withColumn("batch", F.floor(F.col(index) / batch)).withColumn("i", (F.col(index) % batch + 1).cast("int"))
    block = F.concat(F.lit("--- Email "), F.col("i").cast("string"), F.lit(" ---\nSubject: "), strip(text("subject")), F.lit("\n\n"), F.substring(strip(text("body")), 1, body_chars))
    parts = r.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", block.alias("b")))).alias("p"))
    return parts.select("batch", F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("prompt"))
