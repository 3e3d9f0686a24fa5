"""Classifier heads on feature vectors: a registry of estimators, training, comparison."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.sources.shared import new_path

from . import metrics

_HEADS: dict[str, Callable[..., Estimator]] = {}
_ALIASES: dict[str, str] = {}


def register_head(name: str, make: Callable[..., Estimator], *aliases: str) -> None:
    """make(n_features, **parameters) gives an estimator on columns features and label."""
    _HEADS[name] = make
    _ALIASES.update(dict.fromkeys(aliases, name))


def head(name: str, n_features: int, **parameters) -> Estimator:
    name = _ALIASES.get(name, name)
    if name not in _HEADS:
        raise ValueError(f"unknown head {name!r}; there are {heads()}")
    return _HEADS[name](n_features, **parameters)


def heads() -> list[str]:
    return sorted({*_HEADS, *_OWN})


register_head("rf", lambda n, numTrees=150, maxDepth=30, minInstancesPerNode=2, seed=42, **p: RandomForestClassifier(numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, featureSubsetStrategy="sqrt", seed=seed, **p), "random_forest")
register_head("gbt", lambda n, maxIter=500, maxDepth=6, stepSize=0.08, subsamplingRate=0.8, seed=42, **p: OneVsRest(classifier=GBTClassifier(maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, subsamplingRate=subsamplingRate, seed=seed, **p)), "one_vs_rest")
register_head("mlp", lambda n, layers=(256, 64), maxIter=50, seed=42, **p: MultilayerPerceptronClassifier(layers=[n, *layers, 4], maxIter=maxIter, seed=seed, **p))
register_head("logistic", lambda n, maxIter=50, **p: LogisticRegression(maxIter=maxIter, family="multinomial", **p))


_OWN: dict[str, Callable[[DataFrame, str | None, dict], Model]] = {}


def register_fit(name: str, fit: Callable[[DataFrame, str | None, dict], Model], *aliases: str) -> None:
    """A head that is no estimator: fit(rows with features and label, condition of held rows or None, parameters) gives its model."""
    _OWN[name] = fit
    _ALIASES.update(dict.fromkeys(aliases, name))


def _boosted(df: DataFrame, held: str | None, p: dict) -> Model:
    from . import boosting

    return boosting.fit(df, p.pop("classes", 4), held, boosting.Boosting(**p))


register_fit("boosted", _boosted, "xgboost")


def _net(kind: str) -> Callable[[DataFrame, str | None, dict], Model]:
    def fit(df: DataFrame, held: str | None, p: dict) -> Model:
        from . import networks

        return networks.fit(df, kind, p.pop("classes", 4), held, networks.Options(**p))

    return fit


register_fit("perceptron", _net("perceptron"))
register_fit("cnn", _net("convolution"), "convolution")


def fused(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Sparse and dense blocks side by side."""
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def train(df: DataFrame, name: str, validation: str | None = None, **parameters) -> Model:
    """A fitted head. Rows that ``validation`` (a condition) picks are not learned from; boosted trees stop once they get no better on them."""
    if (own := _OWN.get(_ALIASES.get(name, name))) is not None:
        return own(df, validation, parameters)
    n = df.select("features").head()["features"].size
    df = df.withColumn("label", F.col("label").cast("double"))
    if _ALIASES.get(name, name) == "rf" and (model := _large_forest(df if validation is None else df.filter(f"NOT ({validation})"), n, parameters)) is not None:
        return model
    estimator = head(name, n, **parameters)
    if validation is None:
        return estimator.fit(df)
    if isinstance(estimator, OneVsRest) and isinstance(estimator.getClassifier(), GBTClassifier):
        return _stopped_early(df, estimator, validation)
    return estimator.fit(df.filter(f"NOT ({validation})"))


def _large_forest(df: DataFrame, n: int, parameters: dict) -> Model | None:
    """The forest of rows whose trees would be too many for the driver and for Spark's passes; none for few rows, wide vectors and parameters that only Spark's forest has."""
    from . import forest

    o = forest.Forest(**parameters) if set(parameters) <= forest.KNOWN else None
    if o is None or n > forest.WIDEST or df.count() * o.numTrees < forest.LEAST_DRAWS:
        return None
    return forest.fit(df, o)


def _stopped_early(df: DataFrame, estimator: OneVsRest, validation: str) -> OneVsRestModel:
    """One boosted classifier for each class, each with its own stop."""
    trees = estimator.getClassifier().copy()
    trees.setValidationIndicatorCol("__held").setLabelCol("__own")
    classes = int(df.agg(F.max("label")).first()[0]) + 1
    held = df.withColumn("__held", F.expr(validation))
    models = [trees.fit(held.withColumn("__own", (F.col("label") == c).cast("double"))) for c in range(classes)]
    out = OneVsRestModel(models)
    out.setFeaturesCol("features").setPredictionCol("prediction").setRawPredictionCol("rawPrediction")
    return out


def compare(train_df: DataFrame, test_df: DataFrame, names: list[str], parameters: dict[str, dict] | None = None, repeats: int = 5) -> DataFrame:
    """A row for each head: the four-class summary, the phishing scores, the time to fit, the spread of some runs of prediction, and the size of what is saved."""
    rows = []
    spark = train_df.sparkSession
    for name in names:
        t0 = time.perf_counter()
        model = train(train_df, name, **(parameters or {}).get(name, {}))
        fit_s = time.perf_counter() - t0
        scored = model.transform(test_df).select(F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
        n, times = test_df.count(), []
        for _ in range(repeats):
            t1 = time.perf_counter()
            scored.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t1)
        times.sort()
        four, two = metrics.summary(scored).first().asDict(), metrics.binary_metrics(scored).first()
        path = new_path(spark, "head")
        model.write().save(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        size = fs.getContentSummary(at).getLength()
        fs.delete(at, True)
        spread = {"median_s": times[len(times) // 2], "slowest_s": times[-1], "rows_per_s": n / max(times[len(times) // 2], 1e-9)}
        rows.append({"head": name, **four, "phishing_f1": two["f1"], "phishing_recall": two["recall"], "phishing_fpr": two["fpr"], "fit_s": fit_s, **spread, "model_bytes": size})
    return spark.createDataFrame(rows)
