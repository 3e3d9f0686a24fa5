"""Exact top-k search over an impact-ordered index, score at a time.

Vectors are quantised to integers and dealt to blocks. A block's index holds, for
each dimension, postings in segments of falling quantised impact. Each query processes
the segments of all dimensions in its own order, by the greatest impact that one of their
postings may have on a score, either way. A posting adds its product to the vector's accumulator and takes its
square, and the query's, off what is left of the two. After each sixteenth of the postings the proof is tried:
the vector's score lies within the product of the norms of what is left of it and of the
query (Cauchy and Schwarz), and within the greatest and least gains of the open segments. Processing
stops only when these bounds show that all but a few vectors lie below the k-th best lower
bound; these few are rescored exactly. Where the proof never holds, all postings are processed.

Scores are exact at any size. Components whose products could leave the whole numbers that
a double holds are kept out of the index: their vectors are always rescored, in Python's
integers, and a query with such a component meets all vectors that way. Blocks are merged by
exact scores too. A score that 64 bits can't hold is given as null, at the rank that it has.

Queries are shipped to the index: a block's index comes first in its task and the query
blocks stream past it.

Rows with a null id, a null vector or a null or non-finite component take no part.
Vectors may differ in length; a component that is missing counts as 0. Rows that repeat an
id or a vector are rows of their own: only the query's own row is left out. Ties go to the
smaller id, then to the earlier row. Fewer than k other rows give fewer ranks, an empty
table none; other columns take no part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, stored

SCALE = 256
K = 5
EVERY = 50
BLOCK_ROWS, BLOCK_CELLS = 8192, 1 << 22
"""Rows of an index block, and its rows times dimensions, at most."""
QUERY_ROWS = 512
QUERY_GROUP = 64
"""Query blocks that stream past one copy of a block's index."""
LEVELS = 64
STEP = 1 / 16
"""The share of the postings after which the proof is tried again."""
RESCORE, RESCORE_SHARE = 64, 1 / 3
"""Candidates of a block, or the share of it, that are few enough to be rescored: by rows that costs less than another step by postings."""
Best = tuple[int, int, int]


def whole(v: float, scale: int) -> int:
    """floor(scale * v); a double too large to be multiplied is a whole number."""
    y = v * scale
    return math.floor(y) if math.isfinite(y) else int(v) * scale


def narrow_limit(d: int) -> float:
    """Integers up to it may be multiplied and added over d dimensions within a double's whole numbers."""
    return 2.0 ** (26 - math.ceil(math.log2(max(2, d)) / 2))


def quantise(rows: Sequence[np.ndarray], scale: int, d: int) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Whole numbers [rows, d] of narrow rows (others 0), which rows are narrow, and the integers of the wide ones."""
    x = np.zeros((len(rows), d))
    for i, row in enumerate(rows):
        x[i, : len(row)] = row
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    narrow = (np.abs(y) <= narrow_limit(d)).all(1)
    wide = {i: [whole(v, scale) for v in x[i].tolist()] for i in np.flatnonzero(~narrow).tolist()}
    y[~narrow] = 0
    return y, narrow, wide


class Sums:
    """Of each vector of a block, over the postings so far: its products with the query, its squares and the query's.

    All three are whole numbers. Where they fit in a double's whole numbers side by side, they are counted as one number:
    squares + a * products + b * the query's squares, with powers of two a and b; the products lie within the two norms (Cauchy and Schwarz).
    """

    def __init__(self, n: int, norm: float, query: float):
        self.n, self.most = n, math.isqrt(int(norm) * int(query)) + 1
        self.a = 2.0 ** int(norm).bit_length()
        self.b = self.a * 2.0 ** (2 * self.most).bit_length()
        self.joint = self.b * (query + 1) <= 2.0**53
        self.sums = np.zeros(n) if self.joint else np.zeros((3, n))

    def add(self, who: np.ndarray, x: np.ndarray, by: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds postings: the vectors' places and values, and of each run of them the query's value and length. x is changed. The three sums."""
        if not self.joint:
            for row, w in enumerate((np.repeat(by, lens) * x, np.square(x, out=x), np.repeat(by * by, lens))):
                self.sums[row] += np.bincount(who, w, self.n)
            return tuple(self.sums)
        w = np.repeat(self.a * by, lens)
        w += x
        w *= x
        w += np.repeat(self.b * by * by, lens)
        self.sums += np.bincount(who, w, self.n)
        weights = np.floor((self.sums + self.a * self.most) * (1 / self.b))
        rest = self.sums - self.b * weights
        score = np.floor(rest * (1 / self.a))
        return score, rest - self.a * score, weights


class ImpactIndex:
    """The vectors of one block by dimension and falling quantised impact."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, rows: Sequence[np.ndarray], d: int, scale: int = SCALE, levels: int = LEVELS):
        order = np.lexsort((uids, ids))
        self.uids, self.ids, self.row = uids[order], ids[order], {u: i for i, u in enumerate(uids[order].tolist())}
        y, narrow, self.wide = quantise([rows[i] for i in order], scale, d)
        self.x, self.rows = y, np.flatnonzero(narrow)  # of the index; the rest is wide
        x = y[narrow]
        n = len(x)
        self.low, self.high = (x.min(0), x.max(0)) if n else (np.zeros(d), np.zeros(d))
        step = np.maximum((self.high - self.low) / levels, 1e-9)
        level = np.minimum(((x - self.low) / step).astype(np.int64), levels - 1)
        postings, begin, least, most, dim, exact = [], [], [], [], [], []
        for j in range(d if n else 0):
            rows_ = np.argsort(-level[:, j], kind="stable").astype(np.int32)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(level[rows_, j])) + 1])
            values = x[rows_, j]
            postings.append(rows_)
            exact.append(values)
            begin.append(edges + j * n)
            least.append(np.minimum.reduceat(values, edges))
            most.append(np.maximum.reduceat(values, edges))
            dim.append(np.full(len(edges), j))
        joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.postings, self.begin, self.dim = joined(postings, np.int32), joined(begin, np.int64), joined(dim, np.int64)
        self.least, self.most, self.values, self.norm = joined(least, float), joined(most, float), joined(exact, float), (x * x).sum(1)
        self.size = np.diff(np.append(self.begin, len(self.postings)))
        self.places: np.ndarray | None = None  # the postings as they are counted by, made where the index is searched

    def possible(self, q: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, float]:
        """Places in the index that may be among the query's k best, and the share of postings that this took."""
        n = len(self.rows)
        if n <= k + 1:
            return np.arange(n), 0.0
        if self.places is None:
            self.places = self.postings.astype(np.intp)
        w = q[self.dim]
        a, b = w * self.least, w * self.most
        low, high = np.minimum(np.minimum(a, b), 0), np.maximum(np.maximum(a, b), 0)
        order = np.argsort(-np.maximum(high, -low), kind="stable")
        size = self.size[order]
        upto = np.cumsum(size)
        starts = np.flatnonzero(np.append(True, self.dim[1:] != self.dim[:-1]))
        sums = Sums(n, float(self.norm.max()), float(q @ q))
        done = 0
        while True:
            end = int(np.searchsorted(upto, (upto[done - 1] if done else 0) + STEP * upto[-1])) + 1
            part = np.sort(order[done:end])
            # of a dimension's list a step takes a run at either end, or what is left between them
            cut = np.flatnonzero((part[1:] != part[:-1] + 1) | (self.dim[part[1:]] != self.dim[part[:-1]]))
            first, last = part[np.append(0, cut + 1)], part[np.append(cut, len(part) - 1)]
            runs = list(zip(self.begin[first].tolist(), (self.begin[last] + self.size[last]).tolist(), strict=True))
            lens, by = np.array([hi - lo for lo, hi in runs]), q[self.dim[first]]
            who, x = (np.concatenate([c[lo:hi] for lo, hi in runs]) for c in (self.places, self.values))
            score, squares, weights = sums.add(who, x, by, lens)
            low[part] = high[part] = 0
            done += len(part)
            # what a vector may have beyond its accumulator: by the norms of what is left of it and of
            # the query beside it, and by the greatest and least gain of each dimension's open segments
            rest = np.sqrt(np.maximum(self.norm - squares, 0) * np.maximum(float(q @ q) - weights, 0)) * (1 + 1e-9)
            gain, loss = np.maximum.reduceat(high, starts).sum(), np.minimum.reduceat(low, starts).sum()
            above, below = score + np.minimum(rest, gain), score + np.maximum(-rest, loss)
            if own is not None:
                above[own] = below[own] = -np.inf
            found = np.flatnonzero(above >= np.partition(below, n - k)[n - k])
            if len(found) <= max(RESCORE, int(n * RESCORE_SHARE)) or gain <= loss:
                return found, float(upto[done - 1] / upto[-1])

    def search(self, q: np.ndarray | list[int], own_uid: int, k: int = K) -> tuple[list[Best], float]:
        """The k best (score, id, uid) for a query in whole numbers (a list: in integers of any size), its own row left out, ties to smaller ids; and the share of postings processed."""
        own = self.row.get(own_uid)
        found: list[Best] = []
        share = 1.0
        if isinstance(q, list):
            whole_q = q
            scored = [(sum(a * b for a, b in zip(map(int, self.x[i].tolist()), q, strict=True)), i) for i in self.rows.tolist()]
        else:
            whole_q = [int(v) for v in q] if self.wide else []
            place = None
            if own is not None and own not in self.wide:
                place = int(np.searchsorted(self.rows, own))
            some, share = self.possible(q, place, k)
            rows = self.rows[some]
            scores = self.x[rows] @ q
            if len(rows) > k + 1:  # ties with the k-th best stay, and one more for the query's own row
                keep = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                rows, scores = rows[keep], scores[keep]
            scored = list(zip(map(int, scores.tolist()), rows.tolist(), strict=True))
        scored += [(sum(a * b for a, b in zip(row, whole_q, strict=True)), i) for i, row in self.wide.items()]
        found = sorted((-s, self.ids[i].item(), self.uids[i].item()) for s, i in scored if i != own)[:k]
        return [(-s, i, u) for s, i, u in found], share


def order_key(s: int) -> bytes:
    """Bytes that sort as integers do, of any size: sign, length and digits, turned round below 0."""
    m = abs(s)
    data = ((m.bit_length() + 7) // 8).to_bytes(4, "big") + m.to_bytes((m.bit_length() + 7) // 8, "big")
    return b"\x01" + data if s >= 0 else b"\x00" + bytes(255 - c for c in data)


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """uid, vec_id, x of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter("vec_id is not null and x is not null")
    v = v.filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return v.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "x")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", with_share: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for each query, that is each row whose id is divisible by ``every``; with_share adds the share of postings that it processed.

    Blocks are bounded in rows and cells; only their numbers, which follow from counts,
    are known to the driver.
    """
    v = stored(taking_part(vectors, id_col, vector_col), "vectors")
    asking = F.col("vec_id") % every == 0
    n, asked, d = v.agg(F.count("*"), F.count_if(asking), F.max(F.size("x"))).first()
    d = max(1, d or 0)
    blocks = max(1, -(-n // min(block_rows, max(64, BLOCK_CELLS // d))))
    query_blocks = max(1, -(-asked // query_rows))
    groups = -(-query_blocks // QUERY_GROUP)
    dealt = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m)).cast("int")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index = ImpactIndex(pdf["uid"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64), list(pdf["x"]), d, scale)
        return pd.DataFrame({"block": [key[0]], "data": [pickle.dumps(index, 5)]})

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, _, wide = quantise(list(pdf["x"]), scale, d)
        small = x.astype(np.int16) if np.abs(x).max(initial=0) < 1 << 15 else x.astype(np.int32)
        return pd.DataFrame({"qblock": [key[0]], "data": [pickle.dumps((pdf["uid"].tolist(), pdf["vec_id"].tolist(), small, wide), 5)]})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = None, None
        for b in batches:
            for q, data, block in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                what = pickle.loads(data.as_buffer())
                if q < 0:
                    index, at = what, block
                    continue
                if block != at:  # an empty block has no index, and no vectors that could be found
                    continue
                rows = []
                for i, (uid, query_id) in enumerate(zip(*what[:2], strict=True)):
                    best, share = index.search(what[3].get(i, what[2][i].astype(float)), uid, k)
                    rows += [(uid, query_id, vec, s if -(2**63) <= s < 2**63 else None, order_key(s), other, share) for s, vec, other in best]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["quid", "query_id", "vec_id", "score", "key", "uid", "share"])

    each = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    index = v.groupBy(dealt(blocks).alias("block")).applyInPandas(build, "block int, data binary").select("block", each(groups, "grp"), F.lit(-1).alias("qblock"), "data")
    queries = v.filter(asking).groupBy(dealt(query_blocks).alias("qblock")).applyInPandas(gather, "qblock int, data binary")
    queries = queries.select(each(blocks, "block"), F.pmod("qblock", F.lit(groups)).cast("int").alias("grp"), "qblock", "data")
    meet = index.unionByName(queries).repartition(min(blocks * groups, 4096), "block", "grp").sortWithinPartitions("block", "grp", "qblock").select("qblock", "data", "block")
    found = meet.mapInArrow(search, "quid long, query_id long, vec_id long, score long, key binary, uid long, share double")
    best = Window.partitionBy("quid").orderBy(F.col("key").desc(), "vec_id", "uid")
    out = found.withColumn("rank", F.row_number().over(best))
    extra = []
    if with_share:
        out, extra = out.withColumn("share", F.avg("share").over(Window.partitionBy("quid"))), ["share"]
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *extra)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
