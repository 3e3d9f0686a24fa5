"""Gradient-boosted trees with one softmax over all classes, on histograms.

Numbers are replaced once by bins whose borders are quantiles from Spark's mergeable sketch; only those that aren't
zero are kept, so that sparse vectors cost what they hold. A round grows a tree for each class at
once, from one softmax, level by level. For each level every task adds up the gradients and second
derivatives of its rows by (class, node, feature, bin), these sums are merged by key, and each block
of features tells its best split of each node; zeros are what is left of a node's total. The driver sees
the best splits alone. A row's scores are kept with it and brought up to date every few rounds; trees
made since are applied when it is read. Training stops once the loss of held rows hasn't fallen for some rounds.

Rows and features are drawn anew in each round, by hash. Of equal gains the smallest feature and border win. Nothing
depends on how the rows are dealt to tasks, but for the order in which sums are rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.sources.shared import stored

from .learned import ArrayModel, batches_of, entries, softmax

BINS = 64
REFRESH = 8
"""Rounds after which the rows' scores are written anew."""
BLOCKS = 64
"""Blocks of features whose splits are looked for apart."""
_U = np.uint64


@dataclass
class Boosting:
    rounds: int = 500
    eta: float = 0.08
    depth: int = 6
    rows: float = 0.8
    features: float = 0.8
    patience: int = 30
    penalty: float = 1.0
    least_weight: float = 1.0
    bins: int = BINS
    seed: int = 42


@dataclass
class Trees:
    """Complete binary trees [round, class, node]: feature (-1: a leaf), bin and border of the split, value."""

    feature: np.ndarray
    bin: np.ndarray
    border: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, classes: int, depth: int) -> Trees:
        shape = (classes, (2 << depth) - 1)
        return cls(np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.float32), np.zeros(shape))


def drawn(ids: np.ndarray, share: float, salt: int) -> np.ndarray:
    """Which of some numbers a round draws."""
    h = (ids.astype(_U) + _U(salt % 2**63)) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return ((h ^ (h >> _U(31))) >> _U(11)).astype(float) / 2**53 < share


@dataclass
class Borders:
    """Ascending borders of all features, one after the other, and the bin of zero. A number is in the first bin whose border it doesn't exceed."""

    start: np.ndarray
    values: np.ndarray
    zero: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.start) - 1
        self.zero = self.bins_of(np.arange(n), np.zeros(n, np.float32))

    def bins_of(self, feature: np.ndarray, v: np.ndarray) -> np.ndarray:
        low, high = self.start[feature].copy(), self.start[feature + 1].copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            right = open_ & (self.values[np.minimum(mid, max(0, len(self.values) - 1))] < v)
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low - self.start[feature]


def borders(df: DataFrame, n: int, d: int, bins: int) -> Borders:
    """Quantiles of each feature's numbers; zero is one where not all rows have another number."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(parts):
            _, place, v, _ = entries(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(v)], ["feature", "v"])

    shares = [k / bins for k in range(1, bins)]
    found = df.select("features").mapInArrow(run, "feature int, v float").groupBy("feature").agg(F.percentile_approx("v", shares, 10_000).alias("q"), F.count("*").alias("n"))
    rows = {r["feature"]: (np.unique(np.array(r["q"], np.float32)), r["n"]) for r in found.toLocalIterator()}
    out = [np.zeros(0, np.float32)] * d
    for k, (q, count) in rows.items():
        out[k] = np.unique(np.append(q, np.float32(0))) if count < n else q
    return Borders(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64), np.concatenate(out) if out else np.zeros(0, np.float32))


class Rows:
    """A batch of binned rows: entries sorted by row and feature."""

    def __init__(self, b: pa.RecordBatch, d: int, zero: np.ndarray, classes: int):
        self.id, self.label, self.held = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        places, bins = b.column(3), b.column(4)
        lens = np.diff(places.offsets.to_numpy())
        self.n, self.d, self.zero = b.num_rows, d, zero
        self.row = np.repeat(np.arange(self.n), lens)
        self.feature = places.flatten().to_numpy().astype(np.int64)
        self.bin = bins.flatten().to_numpy().astype(np.int64)
        self.key = self.row * d + self.feature
        self.scores = b.column(5).flatten().to_numpy().reshape(self.n, classes).copy()

    def bins_at(self, feature: np.ndarray) -> np.ndarray:
        """Each row's bin of a feature of its own."""
        want = np.arange(self.n) * self.d + feature
        at = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        return np.where(self.key[at] == want, self.bin[at], self.zero[feature]) if len(self.key) else self.zero[feature]

    def nodes(self, tree: Trees, k: int, levels: int) -> np.ndarray:
        """The node of class k's tree that each row reaches."""
        node = np.zeros(self.n, np.int64)
        for _ in range(levels):
            f = tree.feature[k][node]
            right = self.bins_at(np.maximum(f, 0)) > tree.bin[k][node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def add(self, tree: Trees, depth: int) -> None:
        for k in range(self.scores.shape[1]):
            self.scores[:, k] += tree.value[k][self.nodes(tree, k, depth)]


def best_splits(h: pd.DataFrame, total: dict[tuple[int, int], tuple[float, float]], zero: np.ndarray, b: Boosting) -> list[tuple]:
    """(class, node, gain, feature, bin, gradient and weight on the left) of the best split of each node over some features' histograms (k, node, feature, bin, g, h)."""
    best: dict[tuple[int, int], tuple] = {}
    h = h.sort_values(["k", "node", "feature", "bin"])
    for (k, node, f), part in h.groupby(["k", "node", "feature"], sort=True):
        g_all, h_all = total[k, node]
        width = b.bins + 2
        g, w = np.zeros(width), np.zeros(width)
        g[part["bin"]], w[part["bin"]] = part["g"], part["h"]
        g[zero[f]] += g_all - part["g"].sum()
        w[zero[f]] += h_all - part["h"].sum()
        left_g, left_w = np.cumsum(g)[:-1], np.cumsum(w)[:-1]
        right_g, right_w = g_all - left_g, h_all - left_w
        score = lambda g, w: g * g / (w + b.penalty)
        gain = score(left_g, left_w) + score(right_g, right_w) - score(g_all, h_all)
        gain[(left_w < b.least_weight) | (right_w < b.least_weight)] = -np.inf
        at = int(np.argmax(gain))
        if gain[at] > 1e-9 and gain[at] > best.get((k, node), (-np.inf,))[0] + 1e-12:
            best[k, node] = (gain[at], f, at, left_g[at], left_w[at])
    return [(k, node, *x) for (k, node), x in best.items()]


class BoostedModel(ArrayModel):
    @staticmethod
    def scorer(arrays):
        feature, border, value = arrays["feature"], arrays["border"], arrays["value"]

        def run(x: np.ndarray) -> np.ndarray:
            scores, rows = np.tile(arrays["base"], (len(x), 1)), np.arange(len(x))
            for t in range(len(feature)):
                for k in range(feature.shape[1]):
                    node = np.zeros(len(x), np.int64)
                    while True:
                        f = feature[t, k][node]
                        if not (f >= 0).any():
                            break
                        right = x[rows, np.maximum(f, 0)] > border[t, k][node]
                        node = np.where(f >= 0, 2 * node + 1 + right, node)
                    scores[:, k] += value[t, k][node]
            return softmax(scores)

        return run


def fit(df: DataFrame, classes: int = 4, held: str | None = None, options: Boosting | None = None) -> BoostedModel:
    """Boosted trees on columns features and label (0..classes-1); rows that ``held`` (a condition) picks only tell when to stop."""
    b = options or Boosting()
    spark = df.sparkSession
    source = stored(df.select("features", F.col("label").cast("int").alias("label"), (F.expr(held) if held else F.lit(False)).alias("held")), "boosting")
    n = source.filter("not held").count()
    d = source.select("features").head()[0].size
    edges = borders(source.filter("not held"), n, d, b.bins)
    share = {r["label"]: r["count"] for r in source.filter("not held").groupBy("label").count().collect()}
    base = np.log(np.array([max(share.get(k, 0), 0.5) for k in range(classes)]) / max(n, 1))
    at_edges = spark.sparkContext.broadcast(edges)

    def binned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = at_edges.value
        for part in batches_of(parts):
            row, place, v, _ = entries(part.column(3))
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (place.astype(np.int32), e.bins_of(place, v).astype(np.int16))]
            scores = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * classes), pa.array(np.tile(base, part.num_rows)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *lists, scores], ["id", "label", "held", "places", "bins", "scores"])

    schema = "id long, label int, held boolean, places array<int>, bins array<smallint>, scores array<double>"
    # ids that depend on what a row holds, so that draws are the same however the rows are dealt
    rows = stored(source.select(F.xxhash64("features", "label").alias("id"), "label", "held", "features").mapInArrow(binned, schema), "binned")
    done: list[Trees] = []
    pending: list[Trees] = []
    losses: list[float] = []

    def over(parts, made, zero):
        for part in batches_of(parts):
            r = Rows(part, d, zero, classes)
            for tree in made:
                r.add(tree, b.depth)
            yield part, r

    def derivatives(r: Rows, salt: int):
        use = ~r.held & drawn(r.id, b.rows, salt)
        p = softmax(r.scores)
        return use, p - (np.arange(classes) == r.label[:, None]), p * (1 - p)

    for t in range(b.rounds):
        salt, tree = b.seed * 1_000_003 + t, Trees.empty(classes, b.depth)
        shared = spark.sparkContext.broadcast((list(pending), edges.zero))

        def totals(parts, salt=salt, shared=shared):
            made, zero = shared.value
            out = np.zeros((classes + 1, 2))
            for _, r in over(parts, made, zero):
                use, g, h = derivatives(r, salt)
                out[:classes, 0] += g[use].sum(0)
                out[:classes, 1] += h[use].sum(0)
                p = softmax(r.scores)[r.held]
                out[classes] += -np.log(np.maximum(p[np.arange(len(p)), r.label[r.held]], 1e-15)).sum(), len(p)
            yield pa.RecordBatch.from_arrays([pa.array(range(classes + 1), pa.int32()), pa.array(out[:, 0]), pa.array(out[:, 1])], ["k", "g", "h"])

        sums = {r["k"]: (r["g"], r["h"]) for r in rows.mapInArrow(totals, "k int, g double, h double").groupBy("k").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
        if sums[classes][1]:  # the loss before this round's trees
            losses.append(sums[classes][0] / sums[classes][1])
            if len(losses) - 1 - int(np.argmin(losses)) >= b.patience:
                break
        total = {(k, 0): sums[k] for k in range(classes)}
        for level in range(b.depth):
            level_shared = spark.sparkContext.broadcast((list(pending), edges.zero, tree, dict(total)))

            def histograms(parts, salt=salt, level=level, shared=level_shared):
                made, zero, growing, active = shared.value
                open_ = np.zeros(growing.feature.shape, bool)
                for k, node in active:
                    open_[k, node] = True
                keys, gs, hs, width = [], [], [], b.bins + 2
                for _, r in over(parts, made, zero):
                    use, g, h = derivatives(r, salt)
                    picked = use[r.row] & drawn(r.feature, b.features, salt * 31 + 7)
                    for k in range(classes):
                        node = r.nodes(growing, k, level)
                        at = np.flatnonzero(picked & open_[k][node][r.row])
                        key = ((k * growing.feature.shape[1] + node[r.row[at]]) * d + r.feature[at]) * width + r.bin[at]
                        key, where = np.unique(key, return_inverse=True)
                        keys.append(key)
                        gs.append(np.bincount(where, g[r.row[at], k], len(key)))
                        hs.append(np.bincount(where, h[r.row[at], k], len(key)))
                if keys:
                    key, where = np.unique(np.concatenate(keys), return_inverse=True)
                    sums = [np.bincount(where, np.concatenate(x), len(key)) for x in (gs, hs)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, sums)], ["key", "g", "h"])

            def look(pdf: pd.DataFrame) -> pd.DataFrame:
                _, zero, growing, active = level_shared.value  # noqa: B023
                key, width, nodes = pdf["key"].to_numpy(), b.bins + 2, growing.feature.shape[1]
                rest = key // width
                h = pd.DataFrame({"k": rest // d // nodes, "node": rest // d % nodes, "feature": rest % d, "bin": key % width, "g": pdf["g"], "h": pdf["h"]})
                return pd.DataFrame(best_splits(h, active, zero, b), columns=["k", "node", "gain", "feature", "bin", "g", "h"])

            merged = rows.mapInArrow(histograms, "key long, g double, h double").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            block = F.pmod(F.floor(F.col("key") / (b.bins + 2)), F.lit(d)) % BLOCKS
            splits = merged.groupBy(block.alias("block")).applyInPandas(look, "k int, node long, gain double, feature long, bin long, g double, h double")
            best = splits.groupBy("k", "node").agg(F.max_by(F.struct("feature", "bin", "g", "h"), F.struct("gain", -F.col("feature"))).alias("s")).select("k", "node", "s.*").collect()
            following = {}
            for r in best:
                k, node, f = r["k"], r["node"], r["feature"]
                g, w = total[k, node]
                tree.feature[k, node], tree.bin[k, node], tree.border[k, node] = f, r["bin"], edges.values[edges.start[f] + r["bin"]]
                following[k, 2 * node + 1], following[k, 2 * node + 2] = (r["g"], r["h"]), (g - r["g"], w - r["h"])
            for (k, node), (g, w) in total.items():
                tree.value[k, node] = -b.eta * g / (w + b.penalty)
            total = following
            if not total:
                break
        for (k, node), (g, w) in total.items():
            tree.value[k, node] = -b.eta * g / (w + b.penalty)
        done.append(tree)
        pending.append(tree)
        if len(pending) == REFRESH:
            current = spark.sparkContext.broadcast((list(pending), edges.zero))

            def refreshed(parts, shared=current):
                for part, r in over(parts, *shared.value):
                    scores = pa.ListArray.from_arrays(pa.array(np.arange(r.n + 1, dtype=np.int32) * classes), pa.array(r.scores.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:5], scores], part.schema.names)

            rows, pending = stored(rows.mapInArrow(refreshed, schema), "binned"), []
    used = done[: int(np.argmin(losses))] if losses and len(losses) > 1 else done
    used = used or done[:1]
    arrays = {name: np.stack([getattr(t, name) for t in used]) for name in ("feature", "border", "value")}
    return BoostedModel.of(**arrays, base=base, n_features=np.array(d), losses=np.array(losses))
