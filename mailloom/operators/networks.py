"""Neural heads: a perceptron with layer norm and dropout, and a one-dimensional convolutional net, trained side by side.

A hash deals the rows to a fixed number of workers, who hold them for an epoch. Each goes through its own in mixed order with AdamW (cosine
rate), from the same parameters and moments; after the epoch these are averaged by rows. (Exchanging gradients in every step would need a barrier,
whose calls take a second each.) The loss of held rows tells the best parameters and, with patience, the end. The result
depends on the seed and the number of workers, not on how the rows came (but for copies of very frequent rows); a lost worker repeats its epoch.

For dense vectors: averaged parameters go to the driver after every epoch, so that there is a bound on their number. There are as many workers as it
takes for none to have many more than ``Options.rows`` rows; they are averaged in a tree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.sources.shared import stored

from .learned import ArrayModel, softmax

MOST_PARAMETERS = 4_000_000
EPS = 1e-5
Arrays = dict[str, np.ndarray]


@dataclass
class Options:
    epochs: int = 30
    batch: int = 256
    rate: float = 1e-3
    decay: float = 1e-2
    patience: int = 3
    dropout: float = 0.3
    workers: int = 2
    """At least so many."""
    rows: int = 100_000
    """Rows of a worker, about."""
    seed: int = 42


class Linear:
    def __init__(self, name: str, i: int, o: int, rng: np.random.Generator):
        self.w, self.b = f"{name}.w", f"{name}.b"
        self.init = {self.w: rng.normal(0, np.sqrt(2 / i), (i, o)), self.b: np.zeros(o)}

    def forward(self, p: Arrays, x: np.ndarray, train: bool, rng) -> np.ndarray:
        self.x = x
        return x @ p[self.w] + p[self.b]

    def backward(self, p: Arrays, g: np.ndarray, out: Arrays) -> np.ndarray:
        out[self.w], out[self.b] = self.x.T @ g, g.sum(0)
        return g @ p[self.w].T


class Norm:
    """Normalised over some axes, then scaled: over features of a row (layer norm), or over rows and places with running figures (batch norm)."""

    def __init__(self, name: str, n: int, batch: bool):
        self.g, self.b, self.mean, self.var, self.batch = f"{name}.g", f"{name}.b", f"{name}.mean", f"{name}.var", batch
        self.init = {self.g: np.ones(n), self.b: np.zeros(n)} | ({self.mean: np.zeros(n), self.var: np.ones(n)} if batch else {})
        self.axes, self.shape = ((0, 2), (1, n, 1)) if batch else ((1,), (1, n))

    def forward(self, p, x, train, rng):
        if self.batch and not train:
            mean, var = p[self.mean].reshape(self.shape), p[self.var].reshape(self.shape)
        else:
            mean, var = x.mean(self.axes, keepdims=True), x.var(self.axes, keepdims=True)
            self.seen = {self.mean: mean.ravel(), self.var: var.ravel()} if self.batch else {}
        self.sd = np.sqrt(var + EPS)
        self.x = (x - mean) / self.sd
        return self.x * p[self.g].reshape(self.shape) + p[self.b].reshape(self.shape)

    def backward(self, p, g, out):
        over = (0, 2) if self.batch else (0,)
        out[self.g], out[self.b] = (g * self.x).sum(over), g.sum(over)
        g = g * p[self.g].reshape(self.shape)
        return (g - g.mean(self.axes, keepdims=True) - self.x * (g * self.x).mean(self.axes, keepdims=True)) / self.sd


class Relu:
    init: Arrays = {}

    def forward(self, p, x, train, rng):
        self.on = x > 0
        return x * self.on

    def backward(self, p, g, out):
        return g * self.on


class Dropout:
    init: Arrays = {}

    def __init__(self, share: float):
        self.share = share

    def forward(self, p, x, train, rng):
        self.keep = (rng.random(x.shape) >= self.share) / (1 - self.share) if train and self.share else 1.0
        return x * self.keep

    def backward(self, p, g, out):
        return g * self.keep


class Channels:
    """Rows as so many channels."""

    init: Arrays = {}

    def __init__(self, n: int):
        self.n = n

    def forward(self, p, x, train, rng):
        return x.reshape(len(x), self.n, -1)

    def backward(self, p, g, out):
        return g.reshape(len(g), -1)


class Conv:
    """Three places wide, as long as before."""

    def __init__(self, name: str, i: int, o: int, rng: np.random.Generator):
        self.w, self.b = f"{name}.w", f"{name}.b"
        self.init = {self.w: rng.normal(0, np.sqrt(2 / (3 * i)), (o, i, 3)), self.b: np.zeros(o)}

    def forward(self, p, x, train, rng):
        wide = np.pad(x, ((0, 0), (0, 0), (1, 1)))
        self.x = np.stack([wide[:, :, k : k + x.shape[2]] for k in range(3)], 2)  # row, channel, tap, place
        return np.einsum("nckl,ock->nol", self.x, p[self.w], optimize=True) + p[self.b][None, :, None]

    def backward(self, p, g, out):
        out[self.w], out[self.b] = np.einsum("nol,nckl->ock", g, self.x, optimize=True), g.sum((0, 2))
        taps = np.einsum("nol,ock->nckl", g, p[self.w], optimize=True)
        wide = np.zeros((*taps.shape[:2], taps.shape[3] + 2))
        for k in range(3):
            wide[:, :, k : k + taps.shape[3]] += taps[:, :, k]
        return wide[:, :, 1:-1]


class MaxPool:
    init: Arrays = {}

    def forward(self, p, x, train, rng):
        pairs = x[:, :, : x.shape[2] // 2 * 2].reshape(*x.shape[:2], -1, 2)
        self.first, self.width = pairs[..., 0] >= pairs[..., 1], x.shape[2]
        return pairs.max(-1)

    def backward(self, p, g, out):
        both = np.stack([g * self.first, g * ~self.first], -1).reshape(*g.shape[:2], -1)
        return np.pad(both, ((0, 0), (0, 0), (0, self.width - both.shape[2])))


class Average:
    init: Arrays = {}

    def forward(self, p, x, train, rng):
        self.n = x.shape[2]
        return x.mean(2)

    def backward(self, p, g, out):
        return np.repeat(g[:, :, None] / self.n, self.n, 2)


def layers(kind: str, d: int, classes: int, dropout: float, seed: int) -> list:
    rng = np.random.default_rng(seed)
    if kind == "perceptron":
        return [Linear("a", d, 256, rng), Norm("n", 256, False), Relu(), Dropout(dropout), Linear("b", 256, 64, rng), Relu(), Linear("c", 64, classes, rng)]
    if kind == "convolution":
        return [Linear("a", d, 512, rng), Relu(), Channels(32), Conv("k", 32, 64, rng), Norm("m", 64, True), Relu(), MaxPool(), Conv("l", 64, 128, rng), Norm("n", 128, True), Relu(), Average(), Linear("b", 128, 64, rng), Relu(), Dropout(dropout), Linear("c", 64, classes, rng)]
    raise ValueError(f"unknown net {kind!r}")


def scores(net: list, p: Arrays, x: np.ndarray, train: bool = False, rng=None) -> np.ndarray:
    for layer in net:
        x = layer.forward(p, x, train, rng)
    return x


def gradient(net: list, p: Arrays, x: np.ndarray, y: np.ndarray, rng) -> tuple[float, Arrays]:
    """The sum of the rows' losses and its gradient."""
    q = softmax(scores(net, p, x, True, rng))
    out: Arrays = {}
    g = q - (np.arange(q.shape[1]) == y[:, None])
    for layer in reversed(net):
        g = layer.backward(p, g, out)
    return float(-np.log(np.maximum(q[np.arange(len(y)), y], 1e-15)).sum()), out


class NetModel(ArrayModel):
    @staticmethod
    def scorer(arrays: Arrays) -> Callable[[np.ndarray], np.ndarray]:
        net = layers(str(arrays["kind"]), int(arrays["n_features"]), int(arrays["classes"]), 0.0, 0)
        return lambda x: softmax(scores(net, arrays, x.astype(np.float64)))


def _dealt(rows: DataFrame, workers: int, o: Options) -> DataFrame:
    """Rows with their worker: by their hash, and copies of frequent rows in turn."""
    often = rows.groupBy("id").agg(F.count("*").alias("__n")).filter(F.col("__n") > o.rows // 8)  # at most 8 for each worker
    turn = F.when(F.col("__n").isNotNull(), F.floor(F.rand(o.seed) * workers)).otherwise(0)
    return rows.join(F.broadcast(often), "id", "left").withColumn("worker", F.pmod(F.col("id") + turn, F.lit(workers)).cast("int")).drop("__n")


FAN_IN = 8
"""Workers whose parameters are averaged at once."""


def averaged(told: DataFrame, workers: int) -> DataFrame:
    """The workers' rows (worker, n, loss, held, data) as at most FAN_IN: losses summed, data weighted by n; no task holds more than FAN_IN of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("worker")
        total = max(1, int(pdf["n"].sum()))
        data = sum(np.frombuffer(d) * (n / total) for d, n in zip(pdf["data"], pdf["n"], strict=True))
        return pd.DataFrame({"worker": [int(pdf["worker"].iloc[0]) // FAN_IN], "n": [int(pdf["n"].sum())], "loss": [float(pdf["loss"].sum())], "held": [int(pdf["held"].sum())], "data": [data.tobytes()]})

    while workers > FAN_IN:
        told, workers = told.groupBy(F.floor(F.col("worker") / FAN_IN)).applyInPandas(run, told.schema), -(-workers // FAN_IN)
    return told


def fit(df: DataFrame, kind: str = "perceptron", classes: int = 4, held: str | None = None, options: Options | None = None) -> NetModel:
    """A net on columns features and label; of rows that ``held`` (a condition) picks only the loss is looked at."""
    o = options or Options()
    d = df.select("features").head()[0].size
    start = {k: v for layer in layers(kind, d, classes, o.dropout, o.seed) for k, v in layer.init.items()}
    if sum(v.size for v in start.values()) > MOST_PARAMETERS:
        raise ValueError(f"{d} features make more than {MOST_PARAMETERS} parameters; use a dense branch's vectors")
    names = sorted(start)
    rows = df.select(F.xxhash64("features", "label").alias("id"), F.col("label").cast("int").alias("label"), (F.expr(held) if held else F.lit(False)).alias("held"), vector_to_array("features", "float32").alias("x"))

    rows = stored(rows, "rows")
    workers = max(o.workers, -(-rows.count() // o.rows))
    rows = stored(_dealt(rows, workers, o), "dealt")
    flat = lambda *states: np.concatenate([s[k].ravel() for s in states for k in names])

    def apart(x: np.ndarray) -> list[Arrays]:
        out, at = [], 0
        while at < len(x):
            state = {}
            for k in names:
                state[k] = x[at : at + start[k].size].reshape(start[k].shape).copy()
                at += start[k].size
            out.append(state)
        return out

    p, m, v = start, {k: np.zeros_like(a) for k, a in start.items()}, {k: np.zeros_like(a) for k, a in start.items()}
    best, best_loss, since, losses = start, np.inf, 0, []
    for epoch in range(o.epochs + 1):  # the last one only tells the loss
        shared = df.sparkSession.sparkContext.broadcast((flat(p, m, v), epoch))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            state, epoch = shared.value  # noqa: B023
            p, m, v = apart(state)
            pdf = pdf.sort_values("id", kind="stable")
            x, y, out = np.stack(pdf["x"]).astype(np.float64), pdf["label"].to_numpy(np.int64), pdf["held"].to_numpy(bool)
            net, q = layers(kind, d, classes, o.dropout, o.seed), softmax(np.zeros((0, classes)))
            train, val, worker = np.flatnonzero(~out), np.flatnonzero(out), int(pdf["worker"].iloc[0])
            for k in range(0, len(val), 4096):
                q = np.concatenate([q, softmax(scores(net, p, x[val[k : k + 4096]]))])
            loss = float(-np.log(np.maximum(q[np.arange(len(val)), y[val]], 1e-15)).sum())
            rng, size = np.random.default_rng([o.seed, worker, epoch]), max(1, o.batch // min(workers, 16))
            mixed, steps = rng.permutation(train), -(-len(train) // size)
            for s in range(steps if epoch < o.epochs else 0):
                at = mixed[s * size : (s + 1) * size]
                g, t = gradient(net, p, x[at], y[at], rng)[1], epoch * steps + s + 1
                for layer in net:
                    for k, a in layer.seen.items() if isinstance(layer, Norm) else ():
                        p[k] = 0.9 * p[k] + 0.1 * a  # running figures
                rate = o.rate * 0.5 * (1 + np.cos(np.pi * t / (o.epochs * steps + 1)))
                for k, a in g.items():
                    a = a / len(at)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.999 * v[k] + 0.001 * a * a
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + o.decay * p[k])
            return pd.DataFrame({"worker": [worker], "n": [len(train)], "loss": [loss], "held": [len(val)], "data": [flat(p, m, v).tobytes()]})

        told = averaged(rows.groupBy("worker").applyInPandas(run, "worker int, n long, loss double, held long, data binary"), workers)
        told = sorted(told.collect(), key=lambda r: r["worker"])  # at most FAN_IN rows
        if sum(r["held"] for r in told):
            losses.append(sum(r["loss"] for r in told) / sum(r["held"] for r in told))
            best, best_loss, since = (p, losses[-1], 0) if losses[-1] < best_loss else (best, best_loss, since + 1)
            if since >= o.patience:
                break
        else:
            best = p
        total = max(1, sum(r["n"] for r in told))
        p, m, v = apart(sum(np.frombuffer(r["data"]) * (r["n"] / total) for r in told))
    return NetModel.of(**best, kind=np.array(kind), classes=np.array(classes), n_features=np.array(d), losses=np.array(losses))
