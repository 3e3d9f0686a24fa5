"""Toxicity: a linear-chain conditional random field that tags toxic spans.

Tokens are words without surrounding punctuation, in lower case; their features are
the word and its first four, five and six bytes, kept where documents marked toxic use them far
more than others. Tokens with such features get training tags from their document's
label; windows around them train the chain (emissions, transitions) by the exact
gradient, the difference of observed and expected counts from forward and backward
sums. Scoring runs forward and backward over whole documents: only tokens with
features need a step, the runs between them are powers of one 2 x 2 matrix in closed
form. The marginals aggregate to a calibrated document score and to the offsets of
offending tokens.

A null or empty text scores as a text without any offending token. Every input row is
scored, repeated rows and null ids too, and equal texts have equal scores; copies of a text
teach once for each label. An id that several labels name has the largest. Without labels of
both classes there is nothing to learn and every score is the share of toxic labels
(0 without labels). Other columns take no part; an empty table gives no rows.

The field is learned from bounded samples, chosen by hashes: MAX_LABELLED documents and
MAX_WINDOWS of their windows. Its features are all that pass the tests of support and odds; as each
is in a fixed share of the sample's toxic documents, their number is bounded by the sample's tokens. Counting, making windows and scoring the calibration sample happen on executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import crc_remainder, doc_rows, labelled_sample, load, stored, with_columns

MAX_LABELLED = 20_000
"""Bound on the labelled documents that the field is learned from."""
MAX_WINDOWS = 1 << 16
"""Bound on the windows that it is trained on."""
PREFIXES = (4, 5, 6)
FOLDS, HELD_OUT = 3, 1
WINDOW = 3
LENGTH = 4 * (WINDOW + 1)
"""Tokens of a training window."""
THRESHOLD = 0.7
_U = np.uint64
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_KINDS = tuple(_U(k * 0xC2B2AE3D27D4EB4F % 2**64) for k in range(1, 2 + len(PREFIXES)))


@dataclass
class Tokens:
    """Tokens of a run of documents with their feature hashes, a row per token and kind of feature."""

    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    features: np.ndarray


def tokens(column: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    for i, j, w in ws.scan(column, lower=True):
        solid = np.append(np.flatnonzero(~_PUNCT[w.data]), len(w.data))  # bytes that aren't punctuation
        first, last = solid[np.searchsorted(solid, w.starts)], solid[np.searchsorted(solid, w.ends) - 1] + 1
        has = first < w.ends  # a token of punctuation alone stays as it is
        s, e = np.where(has, first, w.starts), np.where(has, last, w.ends)
        f = np.empty((len(s), 1 + len(PREFIXES)), np.uint64)
        f[:, 0] = ws.mix(ws.spans_hash(w.data, s, e) ^ _KINDS[0])
        for k, n in enumerate(PREFIXES, 1):
            f[:, k] = ws.mix(ws.spans_hash(w.data, s, np.minimum(e, s + n)) ^ _KINDS[k])
        yield i, j, Tokens(s, e, w.ptr, w.offsets, w.data, f)


@dataclass
class Crf:
    """Two tags, 0 and 1; tag 0 has potential 0 everywhere, a token's tag 1 has bias plus its features' weights."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0
    small: np.ndarray | None = None

    def lookup(self, f: np.ndarray) -> np.ndarray:
        """Each feature hash's place in the model, or -1."""
        if self.small is None:
            self.small = np.zeros(1 << 16, bool)
            self.small[(self.hashes & _U(0xFFFF)).astype(np.int64)] = True
        out = np.full(f.shape, -1, np.int64)
        if not len(self.hashes):
            return out
        near = self.small[(f & _U(0xFFFF)).astype(np.int64)]
        h = f[near]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out[near] = np.where(self.hashes[at] == h, at, -1)
        return out

    def potentials(self, places: np.ndarray) -> np.ndarray:
        w = np.append(self.weights, 0.0)
        return self.bias + w[places].sum(1)


def chain_marginals(pot: np.ndarray, gap: np.ndarray, tail: np.ndarray, ptr: np.ndarray, bias: float, trans: np.ndarray) -> np.ndarray:
    """P(tag 1) of active tokens, given their potentials, the numbers of plain tokens before each (gap) and after a document's last (tail).

    Forward and backward run step by step over the active tokens of all documents at
    once; a run of g plain tokens is the g-th power of the plain step, from its eigenvalues.
    """
    t = np.exp(trans)
    plain = t * np.array([1.0, np.exp(bias)])  # from tag (row) to tag (column), emission included
    values, right = np.linalg.eig(plain)
    left = np.linalg.inv(right)
    ratio = np.real(values / values[np.argmax(np.abs(values))])
    right, left = np.real(right), np.real(left)

    def power(g: np.ndarray) -> np.ndarray:
        """plain ** g up to a factor."""
        return np.einsum("ij,nj,jk->nik", right, np.sign(ratio) ** (g[:, None] % 2) * np.abs(ratio) ** g[:, None].astype(float), left)

    n_docs, counts = len(ptr) - 1, np.diff(ptr)
    emit = np.stack([np.ones(len(pot)), np.exp(np.clip(pot, -60, 60))], 1)
    out = np.zeros(len(pot))
    if not len(pot):
        return out
    order = np.argsort(-counts, kind="stable")
    alive = np.searchsorted(-counts[order], -np.arange(1, counts.max() + 1), "right")
    first = np.array([1.0, np.exp(bias)])
    alpha = np.zeros((len(pot), 2))
    for k, m in enumerate(alive):
        docs = order[:m]
        at = ptr[docs] + k
        if k == 0:
            g = gap[at]
            before = np.where(g[:, None] > 0, np.einsum("j,njk->nk", first, np.einsum("nij,jk->nik", power(np.maximum(g - 1, 0)), t)), 1.0)
        else:
            before = np.einsum("nj,njk->nk", alpha[at - 1], np.einsum("nij,jk->nik", power(gap[at]), t))
        a = before * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    beta = np.ones((n_docs, 2))
    for k in range(len(alive) - 1, -1, -1):
        docs = order[: alive[k]]
        at = ptr[docs] + k
        last = counts[docs] == k + 1
        if last.any():
            beta[docs[last]] = power(tail[docs[last]]).sum(2)
        p = alpha[at] * beta[docs]
        out[at] = p[:, 1] / p.sum(1)
        b = emit[at] * beta[docs]
        b = np.einsum("nij,nj->ni", np.einsum("nij,jk->nik", power(gap[at]), t), b)
        beta[docs] = b / b.sum(1, keepdims=True)
    return np.clip(out, 0.0, 1.0)


def train_chain(places: np.ndarray, tags: np.ndarray, mask: np.ndarray, n_features: int, steps: int = 150, rate: float = 0.25, l2: float = 0.02) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions from padded windows: places [windows, length, kinds], tags and mask [windows, length]."""
    w, b, tr = np.zeros(n_features + 1), -4.0, np.zeros((2, 2))
    moments = [np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(5), np.zeros(5)]
    n, length = tags.shape
    pair = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[:, :-1][pair], tags[:, 1:][pair]), 1.0)
    for step in range(1, steps + 1):
        pot = b + w[places].sum(2)
        emit = np.stack([np.ones_like(pot), np.exp(np.clip(pot, -40, 40))], 2)
        emit[~mask] = 1.0
        t = np.exp(tr)
        alpha = np.zeros((n, length, 2))
        beta = np.ones((n, length, 2))
        alpha[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
        for i in range(1, length):
            a = np.where(mask[:, i, None], (alpha[:, i - 1] @ t) * emit[:, i], alpha[:, i - 1])
            alpha[:, i] = a / a.sum(1, keepdims=True)
        for i in range(length - 2, -1, -1):
            x = np.where(mask[:, i + 1, None], (emit[:, i + 1] * beta[:, i + 1]) @ t.T, beta[:, i + 1])
            beta[:, i] = x / x.sum(1, keepdims=True)
        p = alpha * beta
        p1 = p[..., 1] / p.sum(2)
        joint = alpha[:, :-1, :, None] * t * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        expected = (joint * pair[..., None, None]).sum((0, 1))
        diff = np.where(mask, tags - p1, 0.0)
        gw = np.bincount((places % (n_features + 1)).ravel(), np.repeat(diff.ravel(), places.shape[2]), n_features + 1) - l2 * w
        gw[n_features] = 0.0
        gs = np.concatenate([[diff.sum()], (seen - expected).ravel()]) - l2 * np.concatenate([[b], tr.ravel()])
        for g, m, v, where in ((gw, moments[0], moments[1], "w"), (gs, moments[2], moments[3], "s")):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            if where == "w":
                w += move
            else:
                b, tr = b + move[0], tr + move[1:].reshape(2, 2)
    return w[:n_features], float(b), tr


def _active(t: Tokens, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices of tokens with features; gaps before each; plain tokens after the last; where each document's begin."""
    act = np.flatnonzero((places >= 0).any(1))
    ptr = np.searchsorted(act, t.ptr)
    docs = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    before = np.empty(len(act), np.int64)
    if len(act):
        before[1:] = act[:-1] + 1
        firsts = ptr[:-1][np.diff(ptr) > 0]
        before[firsts] = t.ptr[docs[firsts]]
    tail = np.zeros(len(ptr) - 1, np.int64)
    has = np.diff(ptr) > 0
    if has.any():
        tail[has] = t.ptr[1:][has] - act[ptr[1:][has] - 1] - 1
    return act, act - before, tail, ptr


def evidence(p: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document: the log odds of its most suspect token and the log of its expected number of toxic tokens."""
    n = len(ptr) - 1
    has = np.diff(ptr) > 0
    top, total = np.full(n, 1e-4), np.zeros(n)
    if has.any():
        at = ptr[:-1][has]
        top[has] = np.maximum(np.maximum.reduceat(p, at), 1e-4)
        total[has] = np.add.reduceat(np.where(p > 0.05, p, 0.0), at)
    top = np.minimum(top, 1 - 1e-4)
    return np.log(top / (1 - top)), np.log1p(total)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


def windows_of(places: np.ndarray, tag: np.ndarray, gap: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows around active tokens: places [windows, LENGTH, kinds] (-1: none), tags and mask [windows, LENGTH]; up to WINDOW plain tokens, then an active one, and so on."""
    near = np.minimum(gap, WINDOW)
    starts = set(ptr[:-1].tolist())
    line, column, fill = np.zeros(len(gap), np.int64), np.zeros(len(gap), np.int64), LENGTH
    k = -1
    for i, (far, g) in enumerate(zip(gap.tolist(), near.tolist(), strict=True)):
        if i in starts or fill + g + 1 > LENGTH or far > 2 * WINDOW:
            k, fill = k + 1, 0
        fill += g + 1
        line[i], column[i] = k, fill - 1
    p = np.full((k + 1, LENGTH, places.shape[1]), -1, np.int32)
    y = np.zeros((k + 1, LENGTH), np.int8)
    p[line, column], y[line, column] = places, tag
    used = np.zeros(k + 1, np.int64)
    np.maximum.at(used, line, column + 1)
    return p, y, np.arange(LENGTH) < used[:, None]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_windows: int = MAX_WINDOWS) -> Crf:
    """Learns from a bounded sample of labelled rows outside the held-out fold. The driver gets candidate features, a bounded number of windows and two numbers for each document."""
    sample = labelled_sample(labels.filter(crc_remainder(FOLDS) != HELD_OUT), "toxic", max_labelled)
    rows = doc_rows(docs).join(F.broadcast(sample), "doc_id").select("text", (F.col("label") > 0).alias("toxic"), F.xxhash64("text").alias("h"))
    rows = stored(rows.dropDuplicates(["h", "toxic"]), "labelled")  # copies of one text would make its words look like evidence
    n = {0: 0, 1: 0} | {int(r[0]): r[1] for r in rows.groupBy("toxic").count().collect()}
    prior = n[1] / max(1, n[0] + n[1])
    if not n[0] or not n[1]:
        return Crf(prior=prior)

    def presence(only: np.ndarray | None):
        """bad, good: in how many toxic and other documents of a run each feature occurs; all features of the toxic ones, or only some."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if only is not None:
                likely = np.zeros(1 << 24, bool)
                likely[(only >> _U(40)).astype(np.int64)] = True
            for b in batches:
                toxic = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for i, j, t in tokens(b.column(0)):
                    want = toxic[i:j] if only is None else np.ones(j - i, bool)
                    doc = np.repeat(np.arange(j - i), np.diff(t.ptr))
                    use = want[doc]
                    f, d = t.features[use], np.repeat(doc[use], t.features.shape[1])
                    f = f.ravel()
                    if only is not None:
                        hit = np.flatnonzero(likely[(f >> _U(40)).astype(np.int64)])
                        hit = hit[only[np.minimum(np.searchsorted(only, f[hit]), len(only) - 1)] == f[hit]]
                        f, d = f[hit], d[hit]
                    if len(f):
                        order = np.argsort(f, kind="stable")  # within a feature by document, as they come
                        f, d = f[order], d[order]
                        new = np.append(True, (f[1:] != f[:-1]) | (d[1:] != d[:-1]))
                        f, d = f[new], d[new]
                        first = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                        bad = np.add.reduceat(toxic[i:j][d].astype(np.int64), first)
                        yield pa.RecordBatch.from_arrays([pa.array(ws.signed(f[first])), pa.array(bad), pa.array(np.diff(np.append(first, len(f))) - bad)], ["f", "bad", "good"])

        return run

    # a candidate is in so many toxic documents of the sample that their number is bounded by its tokens
    least = max(3, round(0.004 * n[1]))
    first = rows.filter("toxic").mapInArrow(presence(None), "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad")).filter(F.col("bad") >= least)
    candidates = np.sort(first.select("f").toPandas()["f"].to_numpy(np.int64).view(np.uint64))
    if not len(candidates):
        return Crf(prior=prior)
    counts = rows.mapInArrow(presence(candidates), "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    odds = np.log((counts["bad"] + 0.5) / (n[1] + 1)) - np.log((counts["good"] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (counts["bad"] + 0.5) + 1 / (counts["good"] + 0.5))
    counts = counts.assign(odds=odds, z=odds / error)
    # far more common in toxic documents; of a document's words only such are evidence for a tag
    counts = counts[(counts["odds"] > 2.5) & (counts["bad"] > counts["good"])].sort_values(["z", "f"], ascending=[False, True])
    if not len(counts):
        return Crf(prior=prior)
    hashes = counts["f"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Crf(hashes=hashes[order], weights=np.zeros(len(order)), prior=prior)
    trusted = (counts["bad"].to_numpy() >= max(3, round(0.01 * n[1])))[order]
    kinds = 1 + len(PREFIXES)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, t in tokens(b.column(0)):
                places = model.lookup(t.features)
                act, gap, _, ptr = _active(t, places)
                if len(act):
                    own = places[act]
                    tag = np.repeat(toxic[i:j], np.diff(ptr)) & np.append(trusted, False)[own].any(1)
                    p, y, mask = windows_of(own, tag, gap, ptr)
                    data = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (p, y, mask)]
                    yield pa.RecordBatch.from_arrays(data, ["p", "y", "mask"])

    made = rows.mapInArrow(windows, "p binary, y binary, mask binary")
    made = made.orderBy(F.xxhash64("p", "y", "mask"), "p", "y", "mask").limit(max_windows).toPandas()
    if not len(made):
        return Crf(prior=prior)
    whole = lambda name, kind: np.frombuffer(b"".join(made[name]), kind)
    p = whole("p", np.int32).reshape(len(made), LENGTH, kinds).astype(np.int64)
    y, mask = whole("y", np.int8).reshape(len(made), LENGTH).astype(np.int64), whole("mask", bool).reshape(len(made), LENGTH)
    model.weights, model.bias, model.trans = train_chain(p, y, mask, len(model.hashes))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in tokens(b.column(0)):
                places = model.lookup(t.features)
                act, gap, tail, ptr = _active(t, places)
                a, c = evidence(chain_marginals(model.potentials(places[act]), gap, tail, ptr, model.bias, model.trans), ptr)
                yield pa.RecordBatch.from_arrays([b.column(2).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(a), pa.array(c)], ["h", "toxic", "a", "c"])

    # calibration on whole documents
    seen = rows.mapInArrow(weighed, "h long, toxic boolean, a double, c double").orderBy("h", "toxic").limit(max_labelled).toPandas()
    x = np.stack([np.ones(len(seen)), seen["a"], seen["c"]], 1)
    model.calibration = tuple(logistic(x, seen["toxic"].to_numpy(float)).tolist())
    return model


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
FIELDS = {"score": (pa.float64(), "double"), "toxic_spans": (SPANS, "array<struct<start:long,end:long,p:double>>")}


def score_batch(column: pa.Array, model: Crf) -> list[pa.Array]:
    """Scores and offending spans (code points, end exclusive) of a batch of texts."""
    scores, spans = [], []
    for i, j, t in tokens(column):
        places = model.lookup(t.features)
        act, gap, tail, ptr = _active(t, places)
        p = chain_marginals(model.potentials(places[act]), gap, tail, ptr, model.bias, model.trans)
        if any(model.calibration):
            a, b = evidence(p, ptr)
            c = model.calibration
            scores.append(1 / (1 + np.exp(-(c[0] + c[1] * a + c[2] * b))))
        else:
            scores.append(np.full(j - i, model.prior))
        points = np.zeros(0, np.int64)
        for d in range(j - i):
            hits = np.arange(ptr[d], ptr[d + 1])[p[ptr[d] : ptr[d + 1]] >= 0.5]
            if not len(hits):
                spans.append([])
                continue
            lo = t.offsets[d]
            points = np.concatenate([[0], np.cumsum((t.data[lo : t.offsets[d + 1]] & 0xC0) != 0x80)])
            spans.append([{"start": int(points[t.starts[act[h]] - lo]), "end": int(points[t.ends[act[h]] - lo]), "p": float(p[h])} for h in hits])
    return [pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(spans, SPANS)]


def score_toxicity(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and toxic_spans, a row for each input row."""
    return with_columns(doc_rows(docs, id_col, text_col), "text", FIELDS, lambda c: score_batch(c, model)).drop("text")


def keep_clean(docs: DataFrame, model: Crf, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with their own columns only."""
    name = "__mailloom_score"
    scored = with_columns(docs, text_col, {name: FIELDS["score"]}, lambda c: score_batch(c, model)[:1])
    return scored.filter(F.col(name) < threshold).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return score_toxicity(docs, model).select("doc_id", (crc_remainder(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_toxic_tokens"), spans.alias("toxic_spans"))
