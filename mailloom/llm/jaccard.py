"""Exact n-gram Jaccard join: size-aware, heavy and light.

Each text is a set of word shingles. Texts with equal sets form a class; only classes
are joined. Two sets of sizes a <= b can link only if they share ceil(t b) shingles.

* Light sets, up to a boundary, enumerate all their subsets of every size that a link may
  need; two light sets that link share such a subset.
* Heavy sets scan inverted lists: shingles are ordered from rare to frequent, and a set
  posts its first n - ceil(t n) + 1, of which any two linked sets share one. Light
  sets within reach of a heavy one post too.

The boundary is chosen by cost: subsets to write against postings to write and lists to
scan, whose mean length comes from a count sketch of all shingles. The sketch, of fixed
size, also gives the frequency order; any order is exact.

A shared shingle counts only where it stands early enough in both sets for what this pair
must share (the first shingle that two sets share has i and j others before it, which
then are not shared, so that they share at most a - i and b - j).

Candidates are verified on whole sets in two rounds. First each set meets one hub of
the lists that it is in: the set with the fewest shingles before the shared one, which in a
group of copies is the one least edited. That joins most groups by as many checks as
there are sets. Then only pairs of different components that still share a list are
checked. Such a pair has a member outside the list's largest component, and a member that
could still link with a set of its own size (were both confined to smaller partners, each
would have to be the smaller one); only these meet the rest of a list, so that neither a large
group nor many texts of one template, which share less than a link needs, pair up with
themselves. Components of all verified links are exact: what is skipped is only between sets
that are joined already.

The number of links needs every pair. All links lie within components, so that each
component's sets, in blocks of a bounded size, meet block by block; what two blocks share
is counted whole, and only sums leave a task, never pairs.

Joins on keys that may be hot have written tables on both sides, so that adaptive execution
can split them.

Null and empty texts have no shingles and are their own component. Rows that repeat an id or a
text are rows of their own. Rows with a null id take part in links, and their component has a
null id only if no row in it has one. Other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import doc_rows, load, merge_tree, stored
from .components import components

SHINGLE = 4
PERCENT = 85
SKETCH_BITS = 21
SKETCH_BLOCK = 1 << 15
BLOOM_BITS = 27
"""The largest filter of wanted sets, for up to an eighth as many of them; beyond that documents are joined with them instead."""
SEEN = 100_000
MAX_SUBSETS = 4096
BLOCK_SETS, BLOCK_ITEMS = 2048, 1 << 20
"""Sets and shingles of a component that meet others at a time."""
SHORT_LIST = 32
DENSE_COLUMNS = 2048
_U = np.uint64


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of documents [i, j): distinct shingle hashes, ascending within each, and where each document's begin."""
    for i, j, w in ws.scan(column, lower=True):
        h = w.hashes()
        x, at = ws.windows(h, w.ptr, size)
        docs = w.docs()
        doc = docs[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = w.counts[short] > k
                whole[has] += h[w.ptr[short[has]] + k] * _U((2 * k + 3) * 0x9FB21C651E98DF25 % 2**64)
            x = np.concatenate([x, ws.mix(whole + w.counts[short].astype(np.uint64))])
            doc = np.concatenate([doc, short])
        order = np.lexsort((x, doc))
        x, doc = x[order], doc[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
        x, doc = x[new], doc[new]
        yield i, j, x, np.searchsorted(doc, np.arange(j - i + 1))


def fingerprints(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, whatever the order; 0 for an empty one."""
    out = np.zeros(len(ptr) - 1, np.uint64)
    has = np.diff(ptr) > 0
    if has.any():
        starts = ptr[:-1][has]
        a = np.add.reduceat(ws.mix(x ^ _U(0x8EBC6AF09C88C6E3)), starts)
        b = np.add.reduceat(ws.mix(x ^ _U(0x589965CC75374CC3)), starts)
        out[has] = ws.mix(a + ws.mix(b))
    return ws.signed(out)


def need(n: int | np.ndarray, percent: int = PERCENT):
    """ceil(t n): what a set of n must share with any partner that isn't larger."""
    return -(-percent * n // 100)


def subset_sizes(n: int, most: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a light set of n enumerates: need(b) for every b from n to its largest light partner."""
    return sorted({need(b, percent) for b in range(n, min(most, 100 * n // percent) + 1)})


def boundary(list_length: float, percent: int = PERCENT) -> int:
    """The largest size up to which enumerating subsets costs no more than posting a prefix and scanning its lists."""
    n = 0
    while n < 64:
        m = n + 1
        subsets = sum(comb(m, c) for c in subset_sizes(m, 100 * m // percent, percent))
        prefix = m - need(m, percent) + 1
        if subsets > MAX_SUBSETS or subsets > prefix * (1 + list_length):
            break
        n = m
    return n


def _dedupe(seen: set, fp: np.ndarray) -> np.ndarray:
    """Which fingerprints are new to this task; a bounded memory, only to save work."""
    fresh = np.zeros(len(fp), bool)
    for k, f in enumerate(fp.tolist()):
        if f not in seen:
            fresh[k] = True
            if len(seen) < SEEN:
                seen.add(f)
    return fresh


def set_sizes(docs: DataFrame, size: int = SHINGLE, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, th, n, fp of every document (th: a hash of the text); and, marked by a part number, each task's count sketch in byte planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "th", "n", "fp", "task", "part", "data"]
        for b in batches:
            ids, hashes = b.column(0), b.column(2)
            for i, j, x, ptr in shingle_sets(b.column(1), size):
                np.add.at(counts, (x >> _U(64 - bits)).astype(np.int64), 1)
                m = j - i
                nothing = [pa.nulls(m, pa.int32())] * 2 + [pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays([ids.slice(i, m), hashes.slice(i, m), pa.array(np.diff(ptr)), pa.array(fingerprints(x, ptr)), *nothing], names)
        task, rows = TaskContext.get().partitionId(), []
        step = min(SKETCH_BLOCK, 1 << bits)
        for k in range(0, len(counts), step):
            part = counts[k : k + step]
            for plane in range(4):
                bytes_ = (part >> np.uint32(8 * plane)).astype(np.uint8)
                if bytes_.any():
                    rows.append((task, k // step, bytes([plane]) + bytes_.tobytes()))
        if rows:
            t, k, c = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(t, pa.int32()), pa.array(k, pa.int32()), pa.array(c, pa.binary())], names)

    return docs.select("doc_id", "text", text_hash().alias("th")).mapInArrow(run, "doc_id long, th long, n long, fp long, task int, part int, data binary")


def text_hash(text_col: str = "text") -> Column:
    """A row's text as a number; with the id it tells rows of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def _add(parts: list[bytes]) -> bytes:
    """The sum of sketch blocks; each begins with the plane of its bytes, or 255 for whole sums."""
    total: np.ndarray | int = 0
    for p in parts:
        x = np.frombuffer(p, np.uint8, offset=1) if p[0] < 255 else np.frombuffer(p, "<i8", offset=1)
        total = total + (x.astype(np.int64) << (8 * p[0] if p[0] < 255 else 0))
    return b"\xff" + np.asarray(total, "<i8").tobytes()


def merged_sketch(planes: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """The sum of all tasks' sketches; 2**bits counters, whatever the input."""
    step = min(SKETCH_BLOCK, 1 << bits)
    out = np.zeros(1 << bits, np.int64)
    for block, data in merge_tree(planes, _add):
        out[block * step : block * step + step] = np.frombuffer(data, "<i8", offset=1)
    return out


def postings(docs: DataFrame, order: np.ndarray, light: int, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, fp, n, pos: prefix postings of heavy sets (pos: place in the frequency order) and subset keys of light ones (pos null).

    ``order`` holds the frequency class of each sketch counter.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order)
    bits = int(len(order)).bit_length() - 1
    post_from = need(light + 1, percent)  # the smallest set that may link with a heavy one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, set()
        for b in batches:
            for _, _, x, ptr in shingle_sets(b.column(1), size):
                n, fp = np.diff(ptr), fingerprints(x, ptr)
                use = _dedupe(seen, fp) & (n > 0)
                doc = np.repeat(np.arange(len(n)), n)
                keep = use[doc] & (n >= post_from)[doc]
                xs, ds = x[keep], doc[keep]
                by = np.lexsort((xs, rank[(xs >> _U(64 - bits)).astype(np.int64)], ds))
                xs, ds = xs[by], ds[by]
                starts = np.searchsorted(ds, np.arange(len(n)))
                pos = np.arange(len(ds)) - starts[ds]
                head = pos < (n - need(n, percent) + 1)[ds]
                keys, who, at = [ws.signed(xs[head])], [ds[head]], [pos[head]]
                mask = [np.zeros(int(head.sum()), bool)]
                for d in np.flatnonzero(use & (n <= light)):
                    own = ws.mix(x[ptr[d] : ptr[d + 1]] ^ _U(0xD1B54A32D192ED03))
                    sums = []
                    total = own.sum(dtype=np.uint64)
                    for c in subset_sizes(int(n[d]), light, percent):
                        salt = _U(c * 0x9E3779B97F4A7C15 % 2**64)
                        out = np.array([own[list(k)].sum(dtype=np.uint64) for k in combinations(range(len(own)), len(own) - c)], np.uint64)
                        sums.append(ws.mix(total - out + salt))
                    sums = np.concatenate(sums) if sums else np.zeros(0, np.uint64)
                    keys.append(ws.signed(sums))
                    who.append(np.full(len(sums), d))
                    at.append(np.zeros(len(sums), np.int64))
                    mask.append(np.ones(len(sums), bool))
                who, mask = np.concatenate(who), np.concatenate(mask)
                if len(who):
                    columns = [pa.array(np.concatenate(keys)), pa.array(fp[who]), pa.array(n[who]), pa.array(np.concatenate(at), mask=mask)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "n", "pos"])

    return docs.mapInArrow(run, "key long, fp long, n long, pos long")


def _keys(fp: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return ws.mix(fp.view(np.uint64) ^ ws.mix(doc_id.view(np.uint64)))


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(ws.mix(keys ^ _U(k)) >> _U(64 - bits)).astype(np.int64) for k in (1, 2)])


def bloom(wanted: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of rows (fp, doc_id), packed: 2**bits bits."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = _bloom_places(_keys(b.column(0).to_numpy(), b.column(1).to_numpy()), bits).ravel()
            np.bitwise_or.at(have, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        if have.any():
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([0], pa.int32()), pa.array([have.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["task", "part", "data"])

    either = lambda parts: np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in parts]).tobytes()
    merged = merge_tree(wanted.select("fp", "doc_id").mapInArrow(fill, "task int, part int, data binary"), either, 16)
    return np.frombuffer(merged[0][1], np.uint8) if merged else np.zeros((1 << bits) // 8, np.uint8)


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int = SHINGLE, most_bits: int = BLOOM_BITS) -> DataFrame:
    """fp, items (hashes as bytes) of the sets in wanted (fp, doc_id): rescanned, and kept where a Bloom filter has the row.

    ``wanted`` names one document of each set, so that copies stay where they are. Rows
    that repeat that document, and rare false hits, may give a set twice or needlessly;
    neither changes which pairs link. The filter has 8 to 16 bits for each set; where that
    would be more than the largest one, a semi-join by document takes its place.
    """
    n = wanted.count()
    bits = max(16, (16 * n).bit_length() - 1)
    d = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text")
    small = bits <= most_bits
    shared = docs.sparkSession.sparkContext.broadcast(bloom(wanted, bits) if small else None)
    if not small:
        d = d.join(stored(wanted.select("doc_id").distinct(), "wanted"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = shared.value, set()
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, x, ptr in shingle_sets(b.column(1), size):
                fp, hit = fingerprints(x, ptr), np.diff(ptr) > 0
                if have is not None:
                    at = _bloom_places(_keys(fp, ids[i:j]), bits)
                    hit &= ((have[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)
                hit = np.flatnonzero(hit)
                hit = hit[_dedupe(seen, fp[hit])]
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[hit]), pa.array([x[ptr[d] : ptr[d + 1]].tobytes() for d in hit], pa.binary())], ["fp", "items"])

    return d.mapInArrow(run, "fp long, items binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of fingerprints whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for k, (a, c) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                a, c = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint64)
                if len(a) > len(c):
                    a, c = c, a
                at = np.minimum(np.searchsorted(c, a), len(c) - 1)
                both = int((c[at] == a).sum())
                ok[k] = 100 * both >= percent * (len(a) + len(c) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["u", "v"])

    s = sets
    left = pairs.join(s.withColumnsRenamed({"fp": "u", "items": "a"}), "u")
    both = left.join(s.withColumnsRenamed({"fp": "v", "items": "b"}), "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long")


def _reach(n: str, pos: str, percent: int) -> Column:
    """The largest set that a set of n may still link with, as it has pos shingles before a shared one; null (any) in a subset key."""
    return F.floor((F.col(n) - F.col(pos)) * (100 + percent) / percent) - F.col(n)


def _may_link(n: str, pos: str, n2: str, pos2: str, percent: int) -> Column:
    """Whether two sets may link for all that their sizes and the places of a shared shingle say; the place is null in a subset key."""
    sizes = 100 * F.least(n, n2) >= percent * F.greatest(n, n2)
    within = lambda n, pos, n2: F.coalesce((100 + percent) * (F.col(n) - F.col(pos)) >= percent * (F.col(n) + F.col(n2)), F.lit(True))
    return sizes & within(n, pos, n2) & within(n2, pos2, n)


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many items each set of a shares with each of b; without b, with each later one of a (the rest is not filled)."""
    sets = a + (b or [])
    n = np.array([len(x) for x in sets])
    items, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(items, kind="stable")  # within an item by set, so that those of a come first
    items, who = items[order], who[order]
    starts = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
    lengths = np.diff(np.append(starts, len(items)))
    column, length = np.repeat(np.arange(len(starts)), lengths), np.repeat(lengths, lengths)
    low, wide = (len(a), len(b)) if b else (0, len(a))
    out = np.zeros((len(a), wide), np.int64)
    few = (length > 1) & (length <= SHORT_LIST)
    c, w = column[few], who[few]
    for k in range(1, min(SHORT_LIST, int(length[few].max(initial=0)))):
        at = np.flatnonzero(c[k:] == c[:-k])
        u, v = w[at], w[at + k]
        if b:
            across = (u < low) & (v >= low)
            u, v = u[across], v[across]
        np.add.at(out, (u, v - low), 1)
    many = length > SHORT_LIST
    if many.any():
        c, w = np.unique(column[many], return_inverse=True)[1], who[many]
        for k in range(0, int(c[-1]) + 1, DENSE_COLUMNS):
            part = slice(*np.searchsorted(c, [k, k + DENSE_COLUMNS]))
            has = np.zeros((len(sets), DENSE_COLUMNS), np.float32)
            has[w[part], c[part] - k] = 1
            out += (has[: len(a)] @ has[low:].T).astype(np.int64)
    return out


def _linked(rows: list[tuple], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a pair of blocks, rows (fp, copies, in the first, items): fp and how many documents its set links with in the other block, or in the same one."""
    rows = list({r[0]: r for r in rows}.values())  # a set may have come twice
    first, second = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    both = first + second
    fp, copies = np.array([r[0] for r in both], np.int64), np.array([r[1] for r in both], np.int64)
    a, b = ([np.frombuffer(r[3], np.uint64) for r in x] for x in (first, second))
    n = np.array([len(x) for x in a + b])
    low, high = (len(a), len(both)) if b else (0, len(a))
    if not a:
        return fp, np.zeros(len(fp), np.int64)
    o = shared_counts(a, b)
    link = 100 * o >= percent * (n[: len(a), None] + n[None, low:high] - o)
    if not b:
        link = np.triu(link, 1)
    out = np.zeros(len(both), np.int64)
    out[: len(a)] += link @ copies[low:high]
    out[low:high] += copies[: len(a)] @ link
    return fp, out


def link_counts(sets: DataFrame, roots: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """fp, links of each set that has any: how many documents with another set link with it.

    ``classes`` has fp, n, copies. Every pair of sets of a component is checked, in one
    task for each pair of the component's blocks.
    """
    members = stored(roots.withColumnRenamed("node", "fp").join(classes.select("fp", "n", "copies"), "fp"), "members")
    blocks = stored(members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_ITEMS)).alias("k")), "blocks")
    own = members.join(blocks, "root").select("fp", "root", "copies", "k", F.pmod(F.xxhash64("fp", F.lit(31)), "k").alias("own"))
    meets = own.join(sets, "fp").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    pairs = meets.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "copies", (F.col("own") <= F.col("other")).alias("first"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, done, held = None, [], [], 0

        def batch() -> pa.RecordBatch:
            fp, links = (np.concatenate(x) for x in zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(fp[links > 0]), pa.array(links[links > 0])], ["fp", "links"])

        for b in batches:
            keys, rest = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True), zip(*(b.column(k).to_pylist() for k in range(3, 7)), strict=True)
            for now, row in zip(keys, rest, strict=True):
                if now != key and rows:
                    done.append(_linked(rows, percent))
                    rows, held = [], held + len(done[-1][0])
                    if held > 1 << 16:
                        yield batch()
                        done, held = [], 0
                key = now
                rows.append(row)
        if rows:
            done.append(_linked(rows, percent))
        if done:
            yield batch()

    dealt = pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(run, "fp long, links long").groupBy("fp").agg(F.sum("links").alias("links"))


def cross_pairs(labelled: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: candidates of different components that share a list; labelled has key, fp, n, pos, comp."""
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("x"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("x.comp").alias("big"))
    reach = F.coalesce(_reach("n", "pos", percent), F.lit(1 << 40))
    own = labelled.join(stored(mixed, "mixed"), "key").withColumn("reach", reach).filter(100 * F.col("reach") >= percent * F.col("n"))
    open_ = stored(own.select("key", "fp", "n", "pos", "comp", (F.col("comp") != F.col("big")).alias("minor"), (F.col("reach") >= F.col("n")).alias("equal")).distinct(), "open")
    other = open_.select("key", *(F.col(c).alias(f"{c}2") for c in ("fp", "n", "pos", "comp", "equal")))
    apart = (F.col("comp") != F.col("comp2")) & _may_link("n", "pos", "n2", "pos2", percent)
    few = open_.filter("minor and equal").join(other, "key").filter(apart)
    rest = open_.filter("minor").join(other.filter("equal2"), "key").filter(apart)
    return few.unionByName(rest).select(F.least("fp", "fp2").alias("u"), F.greatest("fp", "fp2").alias("v")).distinct()


def _joined(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """From documents (doc_id, text): stats (doc_id, th, n, fp of each row), classes of equal sets, their components (node, root), and whole sets."""
    first = stored(set_sizes(docs, size), "sets")
    stats = first.filter("part is null").select("doc_id", "th", "n", "fp")
    sketch = merged_sketch(first.filter("part is not null").select("task", "part", "data"))
    total = max(1, int(sketch.sum()))
    mean_list = float((sketch.astype(float) ** 2).sum()) / total
    order = np.minimum(np.floor(np.log2(np.maximum(sketch, 1)) * 2), 127).astype(np.int8)
    light = boundary(mean_list, percent)

    post = stored(postings(docs, order, light, size, percent), "postings")
    hubs = post.groupBy("key").agg(F.min(F.struct("pos", "fp", "n")).alias("hub"), F.min("fp").alias("low"), F.max("fp").alias("top")).filter("low <> top")
    hubs = stored(hubs.select("key", F.col("hub.fp").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos")), "hubs")
    lists = stored(post.join(hubs, "key"), "lists")
    beside = lists.filter((F.col("fp") != F.col("hub")) & _may_link("n", "pos", "hub_n", "hub_pos", percent))
    votes = beside.groupBy("fp", "hub").agg(F.count("*").alias("c"))
    one = votes.groupBy("fp").agg(F.max(F.struct("c", "hub")).alias("x")).select(F.col("fp").alias("u"), F.col("x.hub").alias("v"))
    one = stored(one, "pairs")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("least")
    classes = stored(stats.filter("n > 0").groupBy("fp", "n").agg(least, F.count("*").alias("copies")), "classes")
    rep = classes.select("fp", F.coalesce("least.doc_id", F.lit(-1)).alias("doc_id"))
    named_in = lambda pairs: pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    wanted = stored(rep.join(named_in(one), "fp", "left_semi"), "wanted")
    sets = stored(whole_sets(docs, wanted, size), "whole")
    links = stored(verified(one, sets, percent), "links")
    roots = components(links)

    # what is left: pairs of different components that share a list
    labelled = lists.select("key", "fp", "n", "pos").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("root", "fp")).drop("root")
    tried = one.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    rest = stored(cross_pairs(stored(labelled, "labelled"), percent).join(tried, ["u", "v"], "left_anti"), "pairs")
    missing = stored(rep.join(named_in(rest), "fp", "left_semi").join(wanted.select("fp"), "fp", "left_anti"), "wanted")
    if missing.head(1):
        sets = sets.unionByName(stored(whole_sets(docs, missing, size), "whole"))
    late = stored(verified(rest, sets, percent), "links")
    if late.head(1):
        roots = components(links.unionByName(late))
    return stats, classes, roots, sets, _named(classes, roots)


def _named(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """fp, n, copies, root and, of the component's rows, the least one (least: no_id, doc_id, th), for each class."""
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "copies", F.coalesce("root", "fp").alias("root"), F.col("least").alias("own"))
    named = stored(named, "named")
    return named.drop("own").join(stored(named.groupBy("root").agg(F.min("own").alias("least")), "least"), "root")


def similar_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and, on demand, n_links, a row for each input row.

    A component's id is its smallest doc_id. n_links counts the other rows that a row
    links with, those with an equal set among them.
    """
    stats, classes, roots, sets, named = _joined(doc_rows(docs, id_col, text_col), percent, size)
    ids = named.select("fp", "n", F.col("least.doc_id").alias("component_id"), "copies")
    extra, none = [], []
    if with_links:
        counted = stored(link_counts(sets, roots, classes, percent), "counts")
        ids = ids.join(counted, "fp", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        extra, none = ["n_links"], [F.lit(0).cast("long").alias("n_links")]
    linked = stats.filter("n > 0").join(stored(ids, "ids"), ["fp", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *extra)
    return linked.unionByName(stats.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *none))


def representatives(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (:func:`text_hash`) of the rows that stand for their components, the ones with the smallest id, null ids last, and of all rows without words; each once."""
    stats, *_, named = _joined(doc_rows(docs, id_col, text_col), percent, size)
    return named.select("least.doc_id", "least.th").unionByName(stats.filter("n = 0").select("doc_id", "th")).distinct()


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(load(spark, sf_dir, "documents"), with_links=True)


SQL = r"""
WITH w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (
  WITH RECURSIVE reach(u, v) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v)
  SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT r.u AS doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, coalesce(k.k, 0) AS n_links
FROM r LEFT JOIN n ON n.doc_id = r.u LEFT JOIN (SELECT u, count(*) AS k FROM e GROUP BY u) k ON k.u = r.u
"""
