"""Heads that are trained here: against brute force, saved, exported and compared."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from mailloom.operators import boosting, heads, latent, networks, portable, tfidf
from mailloom.operators.learned import softmax


def spiral(spark, n=400, seed=1, sparse=False):
    """Four classes that no line tells apart, and two features of noise; every third row is held."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % 4
        a = r.uniform(0.3, 2.5)
        x = [a * np.cos(a + c * np.pi / 2), a * np.sin(a + c * np.pi / 2), r.normal(), r.normal()]
        x = np.round(np.array(x) + r.normal(0, 0.05, 4), 3)
        if sparse:
            x[np.abs(x) < 0.4] = 0
            rows.append((i, Vectors.sparse(4, np.flatnonzero(x).tolist(), x[x != 0].tolist()), c))
        else:
            rows.append((i, Vectors.dense(x.tolist()), c))
    return spark.createDataFrame(rows, ["id", "features", "label"])


def brute_first_splits(x, y, b):
    """The root split of each class's first tree, every feature and border tried; borders are all values (fewer than the bins)."""
    n, classes = len(y), 4
    base = np.log(np.bincount(y, minlength=classes) / n)
    p = softmax(np.tile(base, (n, 1)))
    out = []
    for k in range(classes):
        g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + b.penalty)  # noqa: B023, E731
        tried = []
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[:-1]:
                m = x[:, f] <= t
                if min(h[m].sum(), h[~m].sum()) >= b.least_weight:
                    tried.append((score(m) + score(~m) - score(np.ones(n, bool)), -f, t))
        out.append(max(tried, key=lambda v: v[0]))
    return out


@pytest.mark.parametrize("sparse", [False, True])
def test_split_gains(spark, sparse):
    """On a small table, where quantiles are all values, the first splits are those of brute force and the leaves hold what they should."""
    df = spiral(spark, 60, sparse=sparse)
    b = boosting.Boosting(rounds=1, depth=1, rows=1.0, features=1.0, bins=256, eta=1.0)
    a = boosting.fit(df, 4, None, b).arrays
    x, y = np.array([r["features"].toArray() for r in df.collect()], np.float32), np.array([r["label"] for r in df.collect()])
    p = softmax(np.tile(a["base"], (60, 1)))
    for k, (gain, f, t) in enumerate(brute_first_splits(x, y, b)):
        m = x[:, a["feature"][0, k, 0]] <= a["border"][0, k, 0]
        g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: B023, E731
        assert abs(score(m) + score(~m) - score(np.ones(60, bool)) - gain) < 1e-9
        assert np.allclose(a["value"][0, k, 1:3], [-g[m].sum() / (h[m].sum() + 1), -g[~m].sum() / (h[~m].sum() + 1)])


def loss(df):
    rows = df.select(vector_to_array("probability").alias("p"), "label").collect()
    return -np.mean([np.log(max(r["p"][r["label"]], 1e-12)) for r in rows])


def test_boosted(spark, tmp_path, monkeypatch):
    """Learns what lines can't, better than trees of one class against the rest; saved, loaded and exported it gives the same; noise stops it."""
    monkeypatch.setattr(boosting, "REFRESH", 3)
    df = spiral(spark).persist()
    train, test = df.filter("id % 4 > 0 or id % 16 > 3"), spiral(spark, 200, 9).persist()
    model = heads.train(train, "xgboost", "id % 5 = 0", rounds=10, depth=3, eta=0.4, patience=3)
    scored = model.transform(test)
    assert scored.filter("prediction = label").count() > 150
    old = heads.train(train.withColumn("held", F.expr("id % 5 = 0")), "gbt", "held", maxIter=10, maxDepth=3, stepSize=0.4)
    from mailloom.plans import flows

    other = flows.predict(test.withColumn("text", F.lit("")), old).select("label", F.array(*(F.col("probabilities")[c] for c in flows.CLASSES)).alias("p"))
    assert loss(scored) < -np.mean([np.log(max(r["p"][r["label"]], 1e-12)) for r in other.collect()])
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(test).select("id", vector_to_array("probability").alias("b"))
    onnx = portable.score(test, portable.to_onnx(model), out="c").select("id", "c")
    both = scored.select("id", vector_to_array("probability").alias("a")).join(again, "id").join(onnx, "id").collect()
    assert len(both) == 200 and all(r["a"] == r["b"] and np.allclose(r["a"], r["c"], atol=1e-5) for r in both)
    losses = model.arrays["losses"]
    assert losses[1] < losses[0] and len(model.arrays["feature"]) == max(1, int(np.argmin(losses)))
    moved = heads.train(train.repartition(7), "xgboost", "id % 5 = 0", rounds=2, depth=3, eta=0.4)
    same = heads.train(train.coalesce(1), "xgboost", "id % 5 = 0", rounds=2, depth=3, eta=0.4)
    assert np.array_equal(moved.arrays["feature"], same.arrays["feature"]) and np.allclose(moved.arrays["value"], same.arrays["value"])


def low_rank(seed=0, n=120, d=40, rank=6, noise=0.01):
    r = np.random.default_rng(seed)
    x = (r.standard_normal((n, rank)) * np.geomspace(8, 1, rank)) @ r.standard_normal((rank, d)) + noise * r.standard_normal((n, d))
    x[r.random((n, d)) < 0.3] = 0
    x[5] = 0
    return x


@pytest.mark.parametrize("parts", [1, 40])
def test_latent(spark, tmp_path, parts):
    """The subspace and the singular values are numpy's; dense vectors have length 1 and don't depend on how rows are dealt."""
    x = low_rank()
    vector = lambda i, v: Vectors.sparse(40, np.flatnonzero(v).tolist(), v[v != 0].tolist()) if i % 2 else Vectors.dense(v.tolist())
    df = spark.createDataFrame([(i, vector(i, v), "t") for i, v in enumerate(x)] , ["doc_id", "stylo", "text"])
    df = df.repartition(parts)
    model = latent.fit(df, size=5, extra=8, passes=20)
    u, s, vt = np.linalg.svd(x.astype(np.float32).astype(float), full_matrices=False)
    a = model.arrays
    assert np.allclose(a["values"], s[:5], rtol=1e-6)
    assert np.abs(a["base"] @ a["base"].T - vt[:5].T @ vt[:5]).max() < 1e-5
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    got = {r["doc_id"]: r["sem"].toArray() for r in PipelineModel.load(str(tmp_path / "m")).transform(df).collect()}
    y = x @ a["base"]
    for i in range(len(x)):
        assert np.allclose(got[i], y[i] / max(np.linalg.norm(y[i]), 1e-12), atol=1e-5)
    held = {r["doc_id"]: r["held"] for r in latent.held_shares(df, model).collect()}
    assert held[5] == 0 and all(abs(held[i] - (y[i] @ y[i]) / (x[i] @ x[i])) < 1e-5 for i in range(len(x)) if i != 5)
    rank1 = latent.fit(df.filter("doc_id = 7"), size=5)
    assert rank1.arrays["base"].shape == (40, 1)


def test_latent_of_texts(spark):
    """Texts that share no word but share their words' company are near each other."""
    groups = [["river boat water fish", "boat fish net", "water river"], ["stock price market", "market trade stock", "price trade"]]
    rows = [(3 * g + i, t) for g, texts in enumerate(groups) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    style = tfidf.Stylometric(50, 50).fit(df).transform(df)
    sem = {r["doc_id"]: r["sem"].toArray() for r in latent.fit(style, size=2).transform(style).collect()}
    assert sem[1] @ sem[2] > 0.5 > abs(sem[1] @ sem[5]) and not sem[99].any()


@pytest.mark.parametrize("kind", ["perceptron", "convolution"])
def test_gradients(kind):
    """Every kind of layer against differences."""
    r = np.random.default_rng(0)
    net = networks.layers(kind, 6, 4, 0.0, 1)
    p = {k: v + 0.01 * r.standard_normal(v.shape) for layer in net for k, v in layer.init.items()}
    x, y = r.standard_normal((9, 6)), r.integers(0, 4, 9)
    g = networks.gradient(net, p, x, y, r)[1]
    for k in g:
        for at in r.integers(0, p[k].size, 6):
            old, e = p[k].flat[at], 1e-6
            both = []
            for s in (e, -e):
                p[k].flat[at] = old + s
                both.append(networks.gradient(net, p, x, y, r)[0])
            p[k].flat[at] = old
            assert abs((both[0] - both[1]) / (2 * e) - g[k].flat[at]) < 1e-4 * max(1, abs(g[k].flat[at])), (k, at)
    assert {k for k in p if not k.endswith((".mean", ".var"))} == set(g)


@pytest.mark.parametrize(("name", "epochs"), [("perceptron", 25), ("cnn", 8)])
def test_nets(spark, tmp_path, name, epochs):
    """Learns what lines can't; rows dealt otherwise give the same; saved and loaded; held rows stop it."""
    df, test = spiral(spark, 600).persist(), spiral(spark, 200, 9)
    options = {"epochs": epochs, "batch": 64, "rate": 5e-3}
    model = heads.train(df, name, "id % 5 = 0", **options)
    scored = model.transform(test)
    assert scored.filter("prediction = label").count() > 150
    again = heads.train(df.repartition(7), name, "id % 5 = 0", **options | {"epochs": 2})
    same = heads.train(df.coalesce(1), name, "id % 5 = 0", **options | {"epochs": 2})
    assert all(np.array_equal(again.arrays[k], v) for k, v in same.arrays.items())
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m")).transform(test)
    assert loss(loaded) == loss(scored)
    both = portable.score(scored, portable.to_onnx(model), out="onnx").select(vector_to_array("probability").alias("a"), "onnx").collect()
    assert len(both) == 200 and all(abs(x - y) < 1e-4 for b in both for x, y in zip(b["a"], b["onnx"], strict=True))
    noise = heads.train(df.withColumn("label", (F.xxhash64("id") % 4 + 4) % 4), name, "id % 5 = 0", **options | {"epochs": 40})
    assert len(noise.arrays["losses"]) < 40
    with pytest.raises(ValueError, match="parameters"):
        networks.fit(spark.createDataFrame([(Vectors.sparse(10**6, [1], [1.0]), 0)], ["features", "label"]), "perceptron")


def test_many_workers_and_copies(spark):
    """A worker has about as many rows as it may, though half of all are copies of one; averaging in a tree is averaging."""
    few = networks.Options(epochs=3, batch=32, rows=40, rate=5e-3)
    df = spiral(spark, 400)
    one = df.limit(1).select("features", "label")
    hot = df.select("features", "label").unionByName(one.crossJoin(spark.range(400)).select("features", "label")).persist()
    dealt = networks._dealt(hot.withColumn("id", F.xxhash64("features", "label")), 20, few).groupBy("worker").count().collect()
    assert len(dealt) == 20 and sum(r["count"] for r in dealt) == 800 and max(r["count"] for r in dealt) <= 80
    model = networks.fit(hot, "perceptron", options=few)
    assert np.isfinite(model.transform(df).select(F.max(vector_to_array("probability")[0])).first()[0])
    r = np.random.default_rng(3)
    data, n = r.normal(size=(150, 6)), r.integers(0, 9, 150)
    told = spark.createDataFrame([(k, int(n[k]), 0.5, 1, data[k].tobytes()) for k in range(150)], "worker int, n long, loss double, held long, data binary")
    got = networks.averaged(told, 150).collect()
    assert len(got) == 3 and sum(x["n"] for x in got) == n.sum() and sum(x["held"] for x in got) == 150
    mean = sum(np.frombuffer(x["data"]) * x["n"] for x in got) / n.sum()
    assert np.allclose(mean, (data * n[:, None]).sum(0) / n.sum())
