"""Vectorised scanning of UTF-8 text columns: ASCII-separated words and 64-bit hashes.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; these separators are
single bytes in UTF-8, so a scan over bytes finds the same words as one over code
points. Hashes are polynomials over Z/2^64 with random byte values, finished by a
mixing function; two different words of a corpus collide with a probability of about
n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
"""Bytes that are hashed at a time; bounds the temporary arrays, not the text."""
RUN = 1 << 19
"""Bytes of documents that are scanned together; a longer document is alone."""
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
SEPARATORS = (0x20, *range(0x09, 0x0E))
_SEP = np.zeros(256, bool)
_SEP[[*SEPARATORS]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for offsets 0..n."""
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            tables.append(np.multiply.accumulate(out))
        _powers = (tables[0], tables[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) of data; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + SLICE, "right"))
        j = max(j, i + 1)
        stop = int(ends[j - 1])
        if stop - base > SLICE:
            out[i] = _long_hash(data[base:stop])
        else:
            up, down = _power_tables(SLICE)
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(_VALUE[data[base:stop]] * up[: stop - base], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def _long_hash(span: np.ndarray) -> int:
    up, _ = _power_tables(SLICE)
    total, shift = 0, 1
    step = pow(_BASE, SLICE, 1 << 64)
    for k in range(0, len(span), SLICE):
        part = span[k : k + SLICE]
        total += shift * int(np.sum(_VALUE[part] * up[: len(part)], dtype=np.uint64))
        shift = shift * step % (1 << 64)
    return total % (1 << 64)


class Words:
    """The words of some documents: byte starts and ends, and where each document's begin."""

    __slots__ = ("data", "ends", "offsets", "ptr", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        starts, ends = [], []
        for lo in range(0, len(data), 4 * SLICE):
            hi = min(len(data), lo + 4 * SLICE)
            word = np.zeros(hi - lo + 2, bool)
            word[1:-1] = ~_SEP[data[lo:hi]]
            word[0] = lo > 0 and not _SEP[data[lo - 1]]
            word[-1] = hi < len(data) and not _SEP[data[hi]]
            first = np.zeros(hi - lo + 1, bool)
            inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
            first[inner] = True
            starts.append(np.flatnonzero(word[1:-1] & (first[:-1] | ~word[:-2])) + lo)
            last = first[1:]
            if hi == len(data):
                last[-1] = True
            ends.append(np.flatnonzero(word[1:-1] & (last | ~word[2:])) + lo + 1)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.ptr = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.starts, self.ends)


def windows(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that lie in one document, and their first words' indices."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0xA24BAED4963EE407)) | _U(1)
    m = len(h) - n + 1
    out = h[:m] * keys[0]
    for k in range(1, n):
        out = out + h[k : k + m] * keys[k]
    whole = np.ones(m, bool)
    for k in range(1, n):
        cut = ptr[1:-1] - k
        whole[cut[(cut >= 0) & (cut < m)]] = False
    at = np.flatnonzero(whole)
    return mix(out[at]), at


def released() -> None:
    """Gives the allocators' free memory back to the system: a worker lives on between tasks and would keep its peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def batches(offsets: np.ndarray, most: int = RUN) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) of about so many bytes at most; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def scan(column: pa.Array, lower: bool, most: int = RUN) -> Iterator[tuple[int, int, Words]]:
    """Words of a column's texts, a run of documents [i, j) at a time."""
    data, offsets = buffers(column)
    for i, j in batches(offsets, most):
        part = data[offsets[i] : offsets[j]]
        yield i, j, Words(LOWER[part] if lower else part, offsets[i : j + 1] - offsets[i])
    released()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def word_blocks(text: memoryview | bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of one text as bytes, a list for so many bytes of it; a word that goes on beyond a block comes with the block that ends it."""
    held: list[bytes] = []
    for k in range(0, len(text), size):
        part = bytes(text[k : k + size])
        if k + size >= len(text):
            held.append(part)
            break
        at = max(part.rfind(bytes([c])) for c in SEPARATORS)
        if at < 0:
            held.append(part)
            continue
        yield b"".join([*held, part[:at]]).split()
        held = [part[at:]]
    if held:
        yield b"".join(held).split()


def texts(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each text of a column; a null is an empty text."""
    data, offsets = buffers(column)
    view, ends = memoryview(data), offsets.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield view[a:b]
