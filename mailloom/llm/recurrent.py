"""Language-model scoring with a gated recurrent network in numpy.

Counts of all training tokens come first: they give the base score, the vocabulary
and its classes. The output is class-factored: frequent words are members of classes
with a softmax inside; all other words fall into tail classes by their ending, inside
which a word's share is its discounted count, and words never seen share the
discounts, as one unknown word. At the start the output biases are those frequencies, so that
training begins from a unigram model.

Texts are read twice, for the counts and to be coded as symbols of the head and the tail
classes; training and scoring read the symbols. Training is data-parallel. A number of
workers that follows from the number of training tokens, and not from partitions, shares
the documents by hash; in each round every worker runs truncated backpropagation (windows
of BPTT steps, state carried from window to window) over its documents of the round, and the
weights are averaged by tokens, in a tree. The rounds together see all training documents,
each once.

Scoring runs all documents of a batch side by side, longest first, window by window,
the state carried to the document's end. Of rare words it needs only the counts: the
most frequent ones come with the model, the rest by a join on the word's hash.

A null text counts as empty: one token, the end. Every input row is scored, repeated rows
too, and counts once in training if its id is a training id; a null id counts as an empty
text in the choice of the fold. Equal rows have equal scores. Other columns take no part. An
empty table gives no rows. Words are keyed by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import crc_remainder, doc_rows, load, merge_tree, stored

FOLDS, HELD_OUT = 7, 2
CLASSES, CLASS_WORDS = 32, 32
TAIL_CLASSES = 32
LEXICON = 1 << 18
"""Words whose counts every worker holds; the rest are joined."""
BUCKET_BITS = 20
EMBED, HIDDEN = 24, 32
BPTT = 20
ROUNDS = (0.01, 0.005, 0.002)
"""Learning rates; each round trains on another one of so many parts of the training documents, and the rounds cover all of them."""
WORKER_TOKENS, MAX_WORKERS = 4 << 20, 8192
"""Training tokens for one worker; from so many workers on, each gets more."""
STREAMS, UPDATES = (16, 512), 800
"""A worker's parallel streams, within these bounds so many that it makes about UPDATES updates."""
WINDOW = 1 << 13
"""States whose outputs are worked out together: more of them leave the cache."""
RUN_BYTES = 4 << 20
RUN_SYMBOLS = 1 << 21
"""Symbols of the documents that are scored side by side, longer ones alone: the longest of them sets the number of steps."""
COUNT_LIMIT = 1 << 20
_U = np.uint64
END = np.array([0x2545F4914F6CDD1D], np.uint64)


def keep_memory() -> None:
    """Called by a task before many arrays of some MB: the C library holds on to freed memory of sizes that it has seen freed at once, instead of getting cleared pages anew for each."""
    np.empty(24 << 20, np.uint8)


def tail_class(w: ws.Words) -> np.ndarray:
    """A word's class by its last two bytes."""
    last = w.data[w.ends - 1].astype(np.uint64) if len(w) else np.zeros(0, np.uint64)
    before = w.data[np.maximum(w.ends - 2, w.starts)].astype(np.uint64) if len(w) else last
    return ((ws.mix(last * _U(257) + before) >> _U(40)) % _U(TAIL_CLASSES)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, g (its tail class), c over training documents; the end counts once for each. Combined within tasks in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0
        keep_memory()

        def combined() -> tuple[np.ndarray, np.ndarray]:
            key, c = np.concatenate(words), np.concatenate(counts)
            order = np.argsort(key[:, 0], kind="stable")
            key, c = key[order], c[order]
            new = np.flatnonzero(np.append(True, key[1:, 0] != key[:-1, 0]))
            return key[new], np.add.reduceat(c, new)

        def batch(key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ws.signed(key[:, 0].copy())), pa.array(key[:, 1].astype(np.int32)), pa.array(c)], ["word", "g", "c"])

        for b in batches:
            for i, j, w in ws.scan(b.column(1), lower=True):
                u, at, c = np.unique(w.hashes(), return_index=True, return_counts=True)
                words.append(np.stack([np.append(u, END), np.append(tail_class(w)[at], 0).astype(np.uint64)], 1))
                counts.append(np.append(c, j - i).astype(np.int64))
                held += len(u)
                if held > COUNT_LIMIT:
                    key, c = combined()
                    words, counts, held = [key], [c], len(key)
                    if held > COUNT_LIMIT // 2:
                        yield batch(key, c)
                        words, counts, held = [], [], 0
        if words:
            yield batch(*combined())

    training = docs.filter(crc_remainder(FOLDS) != HELD_OUT).select("doc_id", "text")
    return training.mapInArrow(run, "word long, g int, c long").groupBy("word").agg(F.first("g").alias("g"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What scoring knows of the counts: frequent words by hash, classes, and the tail's totals."""

    hashes: np.ndarray  # ascending
    counts: np.ndarray
    symbols: np.ndarray  # place in the head, or -1
    head: np.ndarray  # hashes of the head's words, most frequent first
    head_counts: np.ndarray
    tail_total: np.ndarray  # training tokens of each tail class
    tail_words: np.ndarray  # distinct words of each
    tokens: int
    distinct: int
    discount: float
    begins: np.ndarray | None = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place, or -1: from where its first bits begin, a few places on."""
        n = len(self.hashes)
        if not n:
            return np.full(len(h), -1)
        if self.begins is None:
            self.begins = np.searchsorted(self.hashes >> _U(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        bucket = (h >> _U(64 - BUCKET_BITS)).astype(np.int64)
        at, end = self.begins[bucket], self.begins[bucket + 1]
        out = np.full(len(h), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            hit = self.hashes[place] == h[left]
            out[left[hit]] = place[hit]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < end[left]]
        return out

    @property
    def end(self) -> int:
        return int(np.flatnonzero(self.head == END[0])[0])

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + 1.0 * (self.distinct + 1)))

    def unknown(self) -> np.ndarray:
        """What is left in each tail class for words never seen."""
        return np.maximum(self.discount * self.tail_words, 0.5)

    def inside_tail(self, c: np.ndarray, g: np.ndarray) -> np.ndarray:
        """log10 of a tail word's share in its class."""
        total = (self.tail_total + self.unknown() - self.discount * self.tail_words)[g]
        return np.log10(np.where(c > 0, np.maximum(c - self.discount, 1e-9), self.unknown()[g]) / total)


def lexicon(counts: DataFrame, most: int = LEXICON) -> Lexicon:
    """From word counts; the driver gets at most so many words, and totals."""
    n = counts.agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    tokens, distinct, ones, twos = (int(x or 0) for x in n)
    step = F.floor(F.log2("c") * 16)  # some hundred steps of frequency: whole ones go in as long as they fit, and of the next one a share by hash
    room, floor, share = most - 1, 1 << 20, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect():
        floor = r["step"]
        if r["n"] > room:
            share = int(0.95 * room / r["n"] * (1 << 30))
            break
        room, share = room - r["n"], 1 << 30
    taken = (step > floor) | ((step == floor) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share))
    top = counts.filter(taken | (F.col("word") == ws.signed(END).tolist()[0])).select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True])
    h, c = top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    head = h[: CLASSES * CLASS_WORDS]
    if END[0] not in head:
        head = np.append(head[: CLASSES * CLASS_WORDS - 1], END)
    by = dict(zip(h.tolist(), c.tolist(), strict=True))
    head_counts = np.array([by.get(x, 0) for x in head.tolist()], np.int64)
    totals = counts.filter(~F.col("word").isin(ws.signed(head).tolist())).groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tail_total, tail_words = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in totals:
        tail_total[r["g"]], tail_words[r["g"]] = r["c"], r["n"]
    order = np.argsort(h)
    place = {x: i for i, x in enumerate(head.tolist())}
    symbols = np.array([place.get(x, -1) for x in h.tolist()], np.int64)
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    return Lexicon(h[order], c[order], symbols[order], head, head_counts, tail_total, tail_words, tokens, distinct, discount)


def layout(n: int, streams: int) -> tuple[int, int]:
    """How many parallel streams a run of n symbols is cut into, and their length; fewer symbols than streams are left over."""
    b = max(1, min(streams, n // (4 * BPTT)))
    return b, (n - 1) // b


def falling_exp(s: np.ndarray) -> np.ndarray:
    """exp of s [kinds, rows], in place, each row's largest moved to 1; the kinds come first because numpy adds up rows faster than within them."""
    s -= s.max(0)
    return np.exp(s, out=s)


class Network:
    """The gated recurrent network: symbols in (head words, tail classes), classes and their words out."""

    def __init__(self, lex: Lexicon, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        k, f = len(lex.head), np.float32
        self.k, self.end = k, lex.end
        self.classes = -(-k // CLASS_WORDS)
        words = np.zeros(self.classes * CLASS_WORDS)
        words[:k] = lex.head_counts + 0.5
        words = words.reshape(self.classes, CLASS_WORDS)
        mass = np.concatenate([words.sum(1), lex.tail_total + 0.5])
        with np.errstate(divide="ignore"):
            inside = np.maximum(np.log(words / words.sum(1, keepdims=True)), -1e4)
        small = lambda *s: rng.normal(0, 0.1, s).astype(f)
        self.p = {
            "emb": small(k + TAIL_CLASSES, EMBED),
            "wx": small(EMBED, 3 * HIDDEN) * 2,
            "bx": np.zeros(3 * HIDDEN, f),
            "wh": small(HIDDEN, 3 * HIDDEN),
            "wc": np.zeros((HIDDEN, self.classes + TAIL_CLASSES), f),
            "bc": np.log(mass / mass.sum()).astype(f),
            "ww": np.zeros((self.classes, HIDDEN, CLASS_WORDS), f),
            "bw": inside.astype(f),
        }

    def thirds(self) -> tuple[np.ndarray, np.ndarray]:
        """Input gates [3, symbols, h] and weights of the state [3, h, h] for reset, update and new state, each in one piece. The signs of the first two are turned, as their sigmoids want them."""
        gates = np.ascontiguousarray((self.p["emb"] @ self.p["wx"] + self.p["bx"]).reshape(-1, 3, HIDDEN).transpose(1, 0, 2))
        w = np.ascontiguousarray(self.p["wh"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
        gates[:2] *= -1
        w[:2] *= -1
        return gates, w

    @staticmethod
    def advance(x: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state from input gates x [3, n, h], state h and its weights, as thirds gives them; and what backpropagation needs."""
        g = h @ w
        rz = x[:2] + g[:2]
        np.exp(np.minimum(rz, 80, out=rz), out=rz)  # a sigmoid this small is zero as a single as well
        rz += 1
        r, z = np.reciprocal(rz, out=rz)
        n = r * g[2]
        n += x[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, r, z, n, g[2]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state from input gates x [n, 3h] and state h; and what backpropagation needs."""
        x = x.reshape(-1, 3, HIDDEN).transpose(1, 0, 2).copy()
        x[:2] *= -1
        return self.advance(x, h, self.thirds()[1])

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of P(symbol y | state h): its class, and in the head the word inside."""
        p = self.p
        tail = y >= self.k
        cls = np.where(tail, self.classes + y - self.k, y // CLASS_WORDS)
        s = p["wc"].T @ h.T + p["bc"][:, None]
        s -= s.max(0)
        out = s[cls, np.arange(len(y))]
        out -= np.log(np.exp(s, out=s).sum(0))
        order = np.argsort(cls, kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        order = order[: edges[-1]]  # states by class, gathered and given back at once
        ranked, word, more, every = h[order], y[order] % CLASS_WORDS, np.empty(len(order), out.dtype), np.arange(len(order))
        for c in range(self.classes):
            lo, hi = edges[c], edges[c + 1]
            if lo < hi:
                s = p["ww"][c].T @ ranked[lo:hi].T + p["bw"][c][:, None]
                s -= s.max(0)
                more[lo:hi] = s[word[lo:hi], every[: hi - lo]]
                more[lo:hi] -= np.log(np.exp(s, out=s).sum(0))
        out[order] += more
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss of a window: inputs x, targets y [streams, steps], state h at its start. An end as input resets the state."""
        p, (b, t) = self.p, x.shape
        gates, w = self.thirds()
        hs, begun, saved = [], [], []
        for i in range(t):
            fresh = np.flatnonzero(x[:, i] == self.end)
            if len(fresh):
                h = h.copy()
                h[fresh] = 0
            new, r, z, n, gn = self.advance(gates.take(x[:, i], 1), h, w)
            begun.append(fresh)
            saved.append((h, r, z, n, gn))
            hs.append(new)
            h = new
        flat, target = np.concatenate(hs), y.T.ravel()
        m = len(target)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        tail = target >= self.k
        cls = np.where(tail, self.classes + target - self.k, target // CLASS_WORDS)
        s = falling_exp(p["wc"].T @ flat.T + p["bc"][:, None])
        s *= (1 / m) / s.sum(0)
        s[cls, np.arange(m)] -= 1 / m
        g["wc"], g["bc"] = flat.T @ s.T, s.sum(1)
        dh = s.T @ p["wc"].T
        order = np.argsort(cls.astype(np.int16), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        order = order[: edges[-1]]  # states by class, gathered and given back at once
        ranked, word, more, every = flat[order], target[order] % CLASS_WORDS, np.empty((len(order), HIDDEN), dh.dtype), np.arange(len(order))
        for c in range(self.classes):
            lo, hi = edges[c], edges[c + 1]
            if lo < hi:
                own = ranked[lo:hi]
                s = falling_exp(p["ww"][c].T @ own.T + p["bw"][c][:, None])
                s *= (1 / m) / s.sum(0)
                s[word[lo:hi], every[: hi - lo]] -= 1 / m
                g["ww"][c], g["bw"][c] = own.T @ s.T, s.sum(1)
                more[lo:hi] = s.T @ p["ww"][c].T
        dh[order] += more
        dx, dg = np.empty((3, t, b, HIDDEN), dh.dtype), np.empty((t, b, HIDDEN), dh.dtype)  # of the gates; and of the state's part in the third
        w = [v.T.copy() for v in (-w[0], -w[1], w[2])]
        back = np.zeros((b, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            prev, r, z, n, gn = saved[i]
            d = dh[i * b : (i + 1) * b] + back
            dr, dz, dn = dx[:, i]
            np.multiply(d, 1 - z, out=dn)
            dn *= 1 - n * n
            np.subtract(prev, n, out=dz)
            d *= z
            dz *= d
            dz *= 1 - z
            np.multiply(dn, r, out=dg[i])
            np.multiply(dg[i], gn, out=dr)
            dr *= 1 - r
            d += dr @ w[0]
            d += dz @ w[1]
            d += dg[i] @ w[2]
            d[begun[i]] = 0
            back = d
        dx, dg, prev = dx.reshape(3, -1, HIDDEN), dg.reshape(-1, HIDDEN), np.concatenate([v[0] for v in saved]).T
        g["wh"] = np.concatenate([prev @ dx[0], prev @ dx[1], prev @ dg], 1)
        inputs = x.T.ravel()
        thirds = [slice(k * HIDDEN, (k + 1) * HIDDEN) for k in range(3)]
        g["bx"] = np.concatenate([v.sum(0) for v in dx])
        taken = p["emb"].take(inputs, 0).T
        for k, v in zip(thirds, dx, strict=True):
            g["wx"][:, k] = taken @ v
        own = sum(v @ p["wx"][:, k].T for k, v in zip(thirds, dx, strict=True))
        order = np.argsort(inputs.astype(np.int16), kind="stable")
        ranked = inputs[order]
        new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        g["emb"][ranked[new]] = np.add.reduceat(own[order], new, axis=0)
        return g, h

    def train(self, symbols: np.ndarray, streams: int, rate: float, moments: dict, done: int) -> int:
        """Truncated backpropagation over a run of whole documents, cut into parallel streams; the state is carried over windows."""
        b, length = layout(len(symbols), streams)
        if length < 1:
            return done
        x = symbols[: b * length].reshape(b, length)
        y = symbols[1 : b * length + 1].reshape(b, length)
        h = np.zeros((b, HIDDEN), np.float32)
        flat, at = np.concatenate([v.ravel() for v in self.p.values()]), 0  # all weights in one array, so that a step is few operations
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        m, s = (moments.setdefault(k, np.zeros_like(flat)) for k in "ms")
        for i in range(0, length, BPTT):
            g, h = self.gradients(x[:, i : i + BPTT], y[:, i : i + BPTT], h)
            d = np.concatenate([g[k].ravel() for k in self.p])
            d *= min(1.0, 1.0 / max(float(np.sqrt(d @ d)), 1e-9))
            done += 1
            m *= 0.9
            m += 0.1 * d
            d *= d
            s *= 0.99
            s += 0.01 * d
            root = float(np.sqrt(1 - 0.99**done))
            flat -= rate * root / (1 - 0.9**done) * m / (np.sqrt(s) + 1e-6 * root)
        return done

    def score(self, symbols: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Natural log probability of each document's symbols (its end included), step by step side by side, the state carried; outputs WINDOW states at a time."""
        gates, w = self.thirds()
        gates, w = gates.astype(np.float32), w.astype(np.float32)
        counts = np.diff(ptr)
        order = np.argsort(-counts, kind="stable")
        lens, first = counts[order], ptr[:-1][order]
        total = np.zeros(len(order))
        steps = int(lens[0]) if len(lens) else 0
        alive = np.searchsorted(-lens, -np.arange(steps), "left").tolist()  # documents longer than t
        h, y = np.zeros((len(order), HIDDEN), np.float32), np.full(len(order), self.end)
        states, targets, held = [], [], 0
        for t, m in enumerate(alive):
            h = self.advance(gates.take(y[:m], 1), h[:m], w)[0]
            y = symbols[first[:m] + t]
            states.append(h)
            targets.append(y)
            held += m
            if held >= WINDOW or t == steps - 1:
                found, at = self.log_probs(np.concatenate(states), np.concatenate(targets)), 0
                for x in targets:
                    total[: len(x)] += found[at : at + len(x)]
                    at += len(x)
                states, targets, held = [], [], 0
        out = np.empty(len(order))
        out[order] = total
        return out


def _symbols(w: ws.Words, lex: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: hash, tail class, place in the lexicon (-1: none), and the symbols with ends, and where each document's begin."""
    h, g = w.hashes(), tail_class(w)
    at = lex.find(h)
    sym = np.append(lex.symbols, -1)[at]
    k = len(lex.head)
    sym = np.where(sym >= 0, sym, k + g)
    n = len(w.ptr) - 1
    ptr = w.ptr + np.arange(n + 1)
    out = np.full(len(sym) + n, lex.end, np.int32)
    out[np.arange(len(sym)) + w.docs()] = sym
    return h, g, at, out, ptr


def coded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """What a second scan of the texts gives, written once, in rows of two kinds.

    One for each input row: uid, doc_id, held_out, n_tokens, n_known and base (log10 sum) of
    the words in the lexicon, tail (log10 of their shares in their tail classes), and its
    symbols as 16-bit integers. And, with the rest null, one for each word of it that is
    not in the lexicon: uid, word, g (its tail class), times.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lex)
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail", "symbols", "word", "g", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        lex = shared.value
        uid, k = TaskContext.get().partitionId() << 32, len(lex.head)
        end_count = int(lex.head_counts[lex.end])
        for b in batches:
            ids, held = b.column(0), b.column(2)
            for i, j, w in ws.scan(b.column(1), True, RUN_BYTES):
                m = j - i
                h, g, at, symbols, ptr = _symbols(w, lex)
                doc, known = w.docs(), at >= 0
                base = np.bincount(doc[known], lex.base(lex.counts[at[known]]), m) + lex.base(np.array(end_count))
                tail = known & (symbols[np.arange(len(h)) + doc] >= k)
                inside = np.bincount(doc[tail], lex.inside_tail(lex.counts[at[tail]], g[tail]), m).astype(float)
                n_known = np.bincount(doc[known], minlength=m) + (end_count > 0)
                data = pa.Array.from_buffers(pa.large_binary(), m, [None, pa.py_buffer((2 * ptr).astype(np.int64)), pa.py_buffer(symbols.astype("<i2"))]).cast(pa.binary())
                uids = uid + np.arange(m)
                uid += m
                none = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(uids), ids.slice(i, m), held.slice(i, m), pa.array(w.counts + 1), pa.array(n_known), pa.array(base), pa.array(inside), data, *none], names)
                rare = np.flatnonzero(~known)
                if len(rare):
                    order = rare[np.argsort(ws.mix(h[rare] ^ (doc[rare].astype(np.uint64) * _U(0x9E3779B97F4A7C15))))]
                    new = np.flatnonzero(np.append(True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
                    times = np.diff(np.append(new, len(order)))
                    o = order[new]
                    none = [pa.nulls(len(o), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(uids[doc[o]]), *none, pa.array(ws.signed(h[o])), pa.array(g[o].astype(np.int32)), pa.array(times)], names)

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail double, symbols binary, word long, g int, times long"
    return stored(docs.select("doc_id", "text", (crc_remainder(FOLDS) == HELD_OUT).alias("held_out")).mapInArrow(run, schema), "coded")


def trained(code: DataFrame, lex: Lexicon, rates: tuple[float, ...] = ROUNDS, worker_tokens: int = WORKER_TOKENS) -> Network:
    """Rounds of local training and averaging.

    Documents are dealt to rounds, and put in order, by what they are, but to workers by the row, so that
    no id or text that many rows repeat weighs on one worker.
    """
    net = Network(lex)
    sc = code.sparkSession.sparkContext
    workers = min(MAX_WORKERS, max(1, -(-lex.tokens // worker_tokens)))
    streams = int(np.clip(lex.tokens // workers // (BPTT * UPDATES), *STREAMS))
    dealt = lambda n, c: F.pmod(F.xxhash64(c, F.lit(29)), F.lit(n)).cast("int")
    training = code.filter("word is null and not held_out").select("uid", "symbols", F.xxhash64("doc_id", "symbols").alias("key")).select("*", dealt(len(rates), "key").alias("round"), dealt(workers, "uid").alias("worker"))
    for part, rate in enumerate(rates):
        now = sc.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            keep_memory()
            start, worker, own = now.value, None, None
            held, n, seen, moments, done = [], 0, 0, {}, 0

            def step(last: bool) -> None:
                nonlocal held, n, done
                symbols = np.concatenate(held)
                b, length = layout(len(symbols), streams)
                done = own.train(symbols, streams, rate, moments, done)
                left = symbols[b * length :]
                if last:
                    done = own.train(left, streams, rate, moments, done)
                held, n = [left], len(left)

            def finished() -> Iterator[pa.RecordBatch]:
                if seen:
                    step(True)
                    weights = np.concatenate([v.ravel() for v in own.p.values()]).astype(np.float64) * seen
                    data = np.append(weights, seen).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([worker], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["task", "part", "data"])

            for b in batches:
                for who, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if who != worker:
                        yield from finished()
                        worker, own = who, pickle.loads(pickle.dumps(start))
                        held, n, seen, moments, done = [np.array([start.end], np.int16)], 1, 0, {}, 0
                    symbols = np.frombuffer(data.as_buffer(), "<i2")
                    held.append(symbols)
                    n += len(symbols)
                    seen += len(symbols)
                    if n > streams * 8 * BPTT:
                        step(False)
            yield from finished()

        shard = training.filter(F.col("round") == part).repartition(workers, "worker").sortWithinPartitions("worker", "key", "uid").select("worker", "symbols")
        add = lambda parts: np.sum([np.frombuffer(x) for x in parts], 0).tobytes()
        merged = merge_tree(shard.mapInArrow(run, "task int, part int, data binary"), add)
        if merged:
            total = np.frombuffer(merged[0][1])
            mean, at = (total[:-1] / total[-1]).astype(np.float32), 0
            for k, v in net.p.items():
                net.p[k] = mean[at : at + v.size].reshape(v.shape).copy()
                at += v.size
    return net


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), a row for each input row."""
    d = doc_rows(docs, id_col, text_col)
    counts = stored(word_counts(d), "counts")
    lex = lexicon(counts)
    code = coded(d, lex)
    shared = d.sparkSession.sparkContext.broadcast(trained(code, lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        net = shared.value
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(b.column(7).to_numpy())])
            score = np.zeros(b.num_rows)
            for i, j in ws.batches(ends, RUN_SYMBOLS):
                symbols = np.frombuffer(b"".join([x.as_buffer() for x in b.column(6).slice(i, j - i)]), "<i2")
                score[i:j] = net.score(symbols, ends[i : j + 1] - ends[i]) / np.log(10)
            total = pa.array(score + b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], total, b.column(7)], ["uid", "doc_id", "held_out", "n_known", "base_score", "score", "n_tokens"])

    rows = code.filter("word is null").select("uid", "doc_id", "held_out", "n_known", F.col("base").alias("base_score"), "tail", "symbols", "n_tokens")
    scored = rows.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_known long, base_score double, score double, n_tokens long")

    c = F.coalesce("c", F.lit(0).cast("long"))
    log_tail = F.log10(F.when(c > 0, F.greatest(c - lex.discount, F.lit(1e-9))).otherwise(F.element_at(F.array(*map(F.lit, lex.unknown().tolist())), F.col("g") + 1)))
    totals = (lex.tail_total + lex.unknown() - lex.discount * lex.tail_words).tolist()
    log_tail = log_tail - F.log10(F.element_at(F.array(*map(F.lit, totals)), F.col("g") + 1))
    log_base = F.log10((c + 1) / F.lit(float(lex.tokens + lex.distinct + 1)))
    rare = code.filter("word is not null").select("uid", "word", "g", "times").join(counts.select("word", "c"), "word", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(log_base * F.col("times")).alias("b2"), F.sum(log_tail * F.col("times")).alias("s2"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    out = scored.join(rare, "uid", "left")
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "k2"), F.lit(lex.tokens).cast("long").alias("train_tokens"), plus("base_score", "b2"), plus("score", "s2"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))
