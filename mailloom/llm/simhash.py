"""SimHash near-duplicates: fingerprints within a Hamming distance, by segment popcounts.

A text's fingerprint has a bit where more than half of its shingles' hashes (XXH64) have
it. A fingerprint is mapped to the popcounts of its segments: a point of a grid whose
Manhattan distance to another is a lower bound of their Hamming distance. Two points within
distance 2 have a point of the grid between them that is at most 1 from each, so every
fingerprint posts to its own point and that point's neighbours, and fingerprints that meet in
a point are candidates, which are verified exactly.

Points where many meet are not paired up: their fingerprints go on to a grid of twice
as many segments. The last grid has one bit a segment, where the Manhattan distance is
the Hamming distance and all that meet in a point link with each other, so that a link
from each to the smallest of them is enough. A link is found at the first grid on which
its two fingerprints meet in a light point; while they meet in crowded ones only, both
go on. So no link of different components is missed, whatever the size of a group, and pairs never
exceed a constant times the postings. The first grid follows from the number of distinct
fingerprints: the coarsest whose points are expected to hold at most one posting each.

Equal fingerprints are one node. Null texts count as empty; texts without words have fingerprint
zero and link like all others. Every input row gives a row; repeated rows and ids are rows
of their own. Rows with a null id take part in links, and their component has a null id only
if no row in it has one. Other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import doc_rows, load, stored
from .components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
"""The largest distance of a link; the grid's construction is made for it."""
SEGMENTS = (8, 16, 32, 64)
LIGHT = 32
"""Fingerprints that may meet in a point and be compared with each other."""
_ODD, _PAIRS, _NIBBLES = 0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F


def fingerprint(blocks: Iterable[list[bytes]], size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text whose words come in blocks; 0 without words."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    hash_of = xxhash.xxh64_intdigest
    for words in blocks:
        words = tail + words
        if (m := len(words) - size + 1) > 0:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
            h = np.fromiter(map(hash_of, shingles, repeat(seed)), np.uint64, m)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += m
        tail = words[1 - size :] if size > 1 else []
    if not n:
        return hash_of(b" ".join(tail), seed) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long, a row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(ws.word_blocks(bytes(text).lower() if len(text) <= ws.SLICE else lowered(text)), size, seed) for text in ws.texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])
            ws.released()

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def lowered(text: memoryview) -> memoryview:
    """A long text with A-Z in lower case."""
    return memoryview(ws.LOWER[np.frombuffer(text, np.uint8)])


def popcounts(fp: Column, segments: int) -> Column:
    """The popcount of each of so many segments of 64 bits, each count in its segment's own bits."""
    if segments == 64:
        return fp
    odd, even = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    x = odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))
    if segments <= 16:
        x = x.bitwiseAND(F.lit(_PAIRS)) + F.shiftrightunsigned(x, 2).bitwiseAND(F.lit(_PAIRS))
    if segments == 8:
        x = x.bitwiseAND(F.lit(_NIBBLES)) + F.shiftrightunsigned(x, 4).bitwiseAND(F.lit(_NIBBLES))
    return x


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def around(point: Column, segments: int) -> Column:
    """The point itself and its neighbours on the grid, as an array."""
    width = 64 // segments
    if segments == 64:
        return F.array(point, *(point.bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))
    out = [point]
    for k in range(segments):
        field = ((1 << width) - 1) << (width * k)
        count = F.shiftrightunsigned(point, width * k).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        rest = point.bitwiseAND(F.lit(_signed(~field % (1 << 64))))
        out.append(F.when(count < width, rest.bitwiseOR(F.shiftleft(count + 1, width * k))))
        out.append(F.when(count > 0, rest.bitwiseOR(F.shiftleft(count - 1, width * k))))
    return F.array_compact(F.array(*out))


def postings(fps: DataFrame, segments: int) -> DataFrame:
    """point, fp: each fingerprint at every grid point within 1 of its own."""
    return fps.select("fp", popcounts(F.col("fp"), segments).alias("own")).select(F.explode(around(F.col("own"), segments)).alias("point"), "fp")


def first_grid(n: int) -> int:
    """The coarsest grid on which n random fingerprints put at most one posting on a point, on average over postings."""
    for segments in SEGMENTS[:-1]:
        width = 64 // segments
        choose = [1.0]
        for k in range(width):
            choose.append(choose[-1] * (width - k) / (k + 1))
        meet = (sum(c * c for c in choose) / 4.0**width) ** segments
        if n * (2 * segments + 1) * meet <= 1:
            return segments
    return SEGMENTS[-1]


def near_links(fps: DataFrame, light: int = LIGHT, segments: int | None = None) -> DataFrame:
    """u, v: pairs of the distinct fingerprints fp within DISTANCE, as many as the components need."""
    rest = fps
    links = []
    for m in SEGMENTS[SEGMENTS.index(segments or first_grid(fps.count())) :]:
        posted = stored(postings(rest, m), "points")
        if m == SEGMENTS[-1]:
            least = stored(posted.groupBy("point").agg(F.count("*").alias("c"), F.min("fp").alias("u")).filter("c > 1").select("point", "u"), "least")
            links.append(posted.join(least, "point").filter("fp <> u").select("u", F.col("fp").alias("v")))
            break
        met = stored(posted.groupBy("point").agg(F.count("*").alias("c")).filter("c > 1"), "met")
        few = stored(posted.join(met.filter(F.col("c") <= light).select("point"), "point"), "few")
        other = few.withColumnRenamed("fp", "fp2")
        links.append(few.join(other, "point").filter((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= DISTANCE)).select(F.col("fp").alias("u"), F.col("fp2").alias("v")))
        rest = stored(posted.join(met.filter(F.col("c") > light).select("point"), "point", "left_semi").select("fp").distinct(), "crowded")
        if not rest.head(1):
            break
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return stored(out.distinct(), "links")


def near_components(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, light: int = LIGHT, segments: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach), a row for each input row."""
    rows = stored(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(fps.select("fp"), light, segments))
    named = stored(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    ids = named.select("fp", "root").join(stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "least"), "root").select("fp", "component_id")
    return rows.join(stored(ids, "ids"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(load(spark, sf_dir, "documents"))
