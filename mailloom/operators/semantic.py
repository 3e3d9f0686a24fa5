"""The semantic branch: dense vectors of texts from any encoder, and class probabilities from them.

An encoder is made once in each worker and gets texts in batches (``predict_batch_udf``);
fine-tuning one is left to whoever brings it. On its vectors a linear softmax head is trained
like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import heads

Encoder = Callable[[list[str]], np.ndarray]
MAX_TOKENS = 512


def embed(df: DataFrame, make_encoder: Callable[[], Encoder], text: str = "text", out: str = "sem_array", batch: int = 32) -> DataFrame:
    """Adds an array of floats for each row's text; a null text counts as empty."""

    def make():
        encode = make_encoder()
        return lambda texts: np.asarray(encode([str(t) for t in np.ravel(texts)]), np.float32)

    run = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return df.withColumn(out, run(F.coalesce(F.col(text), F.lit(""))))


def as_vectors(df: DataFrame, array: str = "sem_array", out: str = "sem") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>"))).drop(array)


def hashed_encoder(size: int = 768) -> Callable[[], Encoder]:
    """A stand-in without a download: the sum of the words' signs at hashed places, of length 1."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            x = np.zeros((len(texts), size))
            for row, t in zip(x, texts, strict=True):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    row[(h >> 1) % size] += 1 - 2 * (h & 1)
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

        return encode

    return make


def onnx_encoder(model_path: str, tokenizer_path: str, most: int = MAX_TOKENS) -> Callable[[], Encoder]:
    """First token's last hidden state of an exported transformer, with its tokenizer file; both files are on every worker."""

    def make() -> Encoder:
        import onnxruntime
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.enable_truncation(most)
        tokenizer.enable_padding()
        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])

        def encode(texts: list[str]) -> np.ndarray:
            rows = tokenizer.encode_batch(texts)
            inputs = {"input_ids": np.array([r.ids for r in rows], np.int64), "attention_mask": np.array([r.attention_mask for r in rows], np.int64)}
            return session.run(None, inputs)[0][:, 0, :]

        return encode

    return make


def fit(df: DataFrame, vectors: str = "sem", label: str = "label", **parameters) -> Model:
    """The softmax head on vectors."""
    return heads.train(df.select(F.col(vectors).alias("features"), F.col(label).alias("label")), "logistic", **parameters)


def probabilities(df: DataFrame, model: Model, vectors: str = "sem", out: str = "probs") -> DataFrame:
    """Adds the class probabilities, an array in class order."""
    names = df.columns
    scored = model.transform(df.withColumn("features", F.col(vectors)))
    return scored.select(*(c for c in names if c != out), vector_to_array("probability").alias(out))


def softmax(scores: list, temperature: float = 1.0) -> list:
    """Probabilities of score columns, on built-in functions."""
    top = F.greatest(*scores)
    parts = [F.exp((s - top) / temperature) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def latest_checkpoint(spark: SparkSession, folder: str, prefix: str = "checkpoint-") -> str | None:
    """The checkpoint folder with the largest step; null without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(path) if s.isDirectory()]
    steps = [(int(name.removeprefix(prefix)), at) for name, at in found if name.startswith(prefix) and name.removeprefix(prefix).isdigit()]
    return max(steps)[1] if steps else None


def best_checkpoint(scores: DataFrame, metric: str = "macro_f1", step: str = "step") -> DataFrame:
    """The row of the best score; of equal ones the earliest step."""
    return scores.orderBy(F.col(metric).desc_nulls_last(), step).limit(1)
