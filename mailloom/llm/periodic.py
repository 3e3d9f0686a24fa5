"""Periodic runs: maximal stretches of words that repeat with a period, by power-of-two naming.

Naming. The words of a text are numbered; the name of the 2^k words from i on is the
rank of the pair of names of its two halves. Levels are made until no two places have the same
name (then no longer stretch repeats), so that prose needs few levels and only texts
that repeat themselves need all. The longest common extension of two places is read from
the names by descending levels: where the names are equal, both places move on by 2^k.

Candidates. A run of period q that is long enough, max(24, 3 q) words, holds one place of a
grid of step max(24, 3 q) - 2 q from which two periods on are inside. For each q the grid's
places are tested by two comparisons of names of the largest power of two up to q; what
passes is extended to the left and right until a word breaks the period. Among stretches
with the same ends the one with the smallest period is the run: by the theorem on two periods
any other period of a stretch of three periods is a multiple of its smallest.

Everything is done for a text at a time with arrays in proportion to its words times the
levels; the grids of all periods together have at most n ln n places, tested in blocks.

A null or empty text has no words and no run. Every input row gives one output row, repeated
rows and null ids (whose decimal text is empty) too. Of runs with equal exponents the first is
reported, then the one with the smaller period. Other columns take no part; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import wordscan as ws
from .common import doc_rows, load

LEAST, TIMES = 24, 3
"""A run has at least so many words and so many periods."""
BLOCK = 1 << 20
"""Places of grids that are tested at a time, and words that are written out at a time."""
PLANTED = 10
"""Documents whose id's checksum is divisible by it get a repeated stretch; see :func:`planted`."""


def numbered(blocks: Iterable[list[bytes]]) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, and the distinct words by number."""
    names: dict[bytes, int] = {}
    parts = [np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words)) for words in blocks]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), list(names)


def planted(x: np.ndarray, doc_id: int | None) -> np.ndarray:
    """A text's words with every word from a on replaced by one of the p words after a, in turn; only where the id's checksum says so."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(x)
    if h % PLANTED or not n:
        return x
    g = h // PLANTED
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return x[np.where(i >= a, a + (i - a) % p, i)]


def levels(x: np.ndarray) -> list[np.ndarray]:
    """Names of the 2^k words from each place on, for every k up to the last at which a name occurs twice."""
    out: list[np.ndarray] = []
    names, k = x, 0
    while len(names):
        distinct, ranks = np.unique(names, return_inverse=True)
        if len(distinct) == len(names):
            break
        out.append(ranks.astype(np.int32))
        half = 1 << k
        pairs = ranks[: max(0, len(ranks) - half)] * np.int64(len(distinct))
        names, k = pairs + ranks[half:], k + 1
    return out


def extend(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """How many words from i on equal those from j on; i < j."""
    j = j.copy()
    first, shift = j.copy(), j - i
    for k in range(len(names) - 1, -1, -1):
        at = np.flatnonzero(j + (1 << k) <= n)
        at = at[names[k][j[at] - shift[at]] == names[k][j[at]]]
        j[at] += 1 << k
    return j - first


def extend_back(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j; i < j."""
    i = i.copy()
    first, shift = i.copy(), j - i
    for k in range(len(names) - 1, -1, -1):
        at = np.flatnonzero(i >= 1 << k)
        left = i[at] - (1 << k)
        i[at[names[k][left] == names[k][left + shift[at]]]] -= 1 << k
    return first - i


def grid(low: int, high: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of grid places and their periods, for all periods from low to high - 1."""
    q = np.arange(low, min(high, n // TIMES + 1), dtype=np.int64)
    step = np.maximum(LEAST, TIMES * q) - 2 * q
    count = (n - 2 * q) // step + 1
    upto = np.cumsum(count)
    for begin in range(0, int(upto[-1]) if len(q) else 0, BLOCK):
        m = np.arange(begin, min(begin + BLOCK, int(upto[-1])))
        which = np.searchsorted(upto, m, "right")
        yield (m - (upto - count)[which]) * step[which], q[which]


def runs(x: np.ndarray) -> np.ndarray:
    """start, length, period of every run, by start, then period."""
    n, names = len(x), levels(x)
    found = [np.zeros((0, 3), np.int64)]
    for k, name in enumerate(names):
        for i, q in grid(1 << k, 2 << k, n):
            tail = i + q - (1 << k)
            ok = (name[i] == name[i + q]) & (name[tail] == name[tail + q])
            i, q = i[ok], q[ok]
            if not len(i):
                continue
            left, right = extend_back(names, i, i + q), extend(names, i, i + q, n)
            length = left + q + right
            ok = length >= np.maximum(LEAST, TIMES * q)
            found.append(np.unique(np.stack([(i - left)[ok], length[ok], q[ok]], 1), axis=0))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    same = np.zeros(len(every), bool)
    same[1:] = (every[1:, :2] == every[:-1, :2]).all(1)
    every = every[~same]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; the first of those, then the one with the smallest period."""
    best = None
    for start, length, period in found.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which words stay when every run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def _joined(x: np.ndarray, words: list[bytes]) -> Iterator[bytes]:
    for k in range(0, len(x), BLOCK):
        yield (b" " if k else b"") + b" ".join([words[i] for i in x[k : k + BLOCK].tolist()])


def _document(text: memoryview, doc_id: int | None, plant: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A text's words as numbers, its runs, and the words by number."""
    x, words = numbered(ws.word_blocks(text))
    x = planted(x, doc_id) if plant else x
    return x, runs(x), words


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, period: a row for every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), ws.texts(b.column(1)), strict=True):
                found = _document(text, doc, False)[1]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), *(pa.array(c) for c in np.ascontiguousarray(found.T))], ["doc_id", "start", "length", "period"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: every run cut down to its first period, the words joined by single blanks; a row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), ws.texts(b.column(1)), strict=True):
                x, found, words = _document(text, doc, False)
                out.append(b"".join(_joined(x[kept(len(x), found)], words)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


FIELDS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def digest(text: memoryview, doc_id: int | None, plant: bool = True) -> tuple:
    """The values of FIELDS for one text."""
    x, found, words = _document(text, doc_id, plant)
    best = strongest(found)
    listed, left = hashlib.sha256(), hashlib.sha256()
    for row in found.tolist():
        listed.update(b"%d,%d,%d\n" % tuple(row))
    for part in _joined(x[kept(len(x), found)], words):
        left.update(part)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *first, listed.hexdigest(), left.hexdigest())


def run_digests(docs: DataFrame, plant: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and FIELDS, a row for each input row; with ``plant``, of texts changed by :func:`planted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digest(text, doc, plant) for doc, text in zip(b.column(0).to_pylist(), ws.texts(b.column(1)), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(columns, FIELDS.values(), strict=True))], ["doc_id", *FIELDS])
            ws.released()

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return doc_rows(docs, id_col, text_col).mapInArrow(run, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(load(spark, sf_dir, "documents"))
