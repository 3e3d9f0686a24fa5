"""Training in phases, each kept as tables under a key of its parameters, so that a rerun resumes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators import heads, latent, metrics, sampling
from mailloom.operators.tfidf import MAX_TERMS, Stylometric
from mailloom.plans import flows


@dataclass(frozen=True)
class Training:
    """What a run depends on; another value of any of it is another run."""

    per_cohort: int = 16_000
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)
    seed: int = 42
    word_terms: int = MAX_TERMS
    char_terms: int = MAX_TERMS
    head: str = "rf"
    mode: str = "stylometric"
    size: int = latent.SIZE

    def key(self, *names: str) -> str:
        chosen = {k: v for k, v in asdict(self).items() if not names or k in names}
        return hashlib.md5(json.dumps(chosen, sort_keys=True).encode()).hexdigest()[:12]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def splits(records: DataFrame, t: Training, folder: str, key: str = "doc_id", resume: bool = True) -> DataFrame:
    """Records sampled by cohort, with split; read again if a run with these parameters has left them."""
    spark, path = records.sparkSession, f"{folder}/splits-{t.key('per_cohort', 'ratios', 'seed')}"
    if not (resume and _exists(spark, f"{path}/_SUCCESS")):
        sampled = sampling.sample_per_group(records, "cohort", t.per_cohort, t.seed, key)
        sampling.stratified_split(sampled, "cohort", t.ratios, t.seed, key).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def vectors(records: DataFrame, t: Training, folder: str, key: str = "doc_id", resume: bool = True) -> tuple[DataFrame, Stylometric]:
    """Records with split, features (of the mode's branches) and label; blocks, and the dense branch's singular vectors, fitted on the training split are read again if a run with these parameters has left them."""
    spark = records.sparkSession
    s = splits(records, t, folder, key, resume)
    style = f"{folder}/stylo-{t.key('per_cohort', 'ratios', 'seed', 'word_terms', 'char_terms')}"
    if resume and _exists(spark, f"{style}/char/_SUCCESS"):
        stylo = Stylometric.load(spark, style)
    else:
        stylo = Stylometric(t.word_terms, t.char_terms).fit(s.filter("split = 'train'"), "text", key)
        stylo.save(style)
        stylo = Stylometric.load(spark, style)
    if t.mode == "stylometric":
        return stylo.transform(s, "text", "features", key).withColumn("label", F.col("cohort")), stylo
    rows = stylo.transform(s, "text", "stylo", key).withColumn("label", F.col("cohort"))
    path = f"{folder}/latent-{t.key('per_cohort', 'ratios', 'seed', 'word_terms', 'char_terms', 'size')}"
    if not (resume and _exists(spark, f"{path}/metadata/_SUCCESS")):
        model = latent.fit(rows.filter("split = 'train'"), t.size, seed=t.seed)
        PipelineModel([model]).write().overwrite().save(path)
    return flows.with_features(PipelineModel.load(path).transform(rows), t.mode), stylo


def train(records: DataFrame, t: Training, folder: str, key: str = "doc_id", resume: bool = True) -> tuple[PipelineModel, DataFrame]:
    """(model on column features, metrics on the test split) of records with text and cohort."""
    spark = records.sparkSession
    rows, _ = vectors(records, t, folder, key, resume)
    path = f"{folder}/head-{t.key()}"
    if resume and _exists(spark, f"{path}/metadata/_SUCCESS"):
        model = PipelineModel.load(path)
    else:
        model = PipelineModel([heads.train(rows.filter("split <> 'test'"), t.head, "split = 'val'")])
        model.write().overwrite().save(path)
    scored = model.transform(rows.filter("split = 'test'")).select(F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
    return model, metrics.summary(scored)
