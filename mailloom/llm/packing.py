"""Packing token pieces into sequences: first-fit decreasing over a tournament tree.

Documents are tokenised and cut at every ``capacity`` tokens. The pieces are dealt to
randomised groups of documents, and each group is packed on its own: the longest piece
first, into the leftmost bin that still has room, which a tournament tree of the bins'
free capacities finds in logarithmic time. Bins that stay badly filled are dissolved:
their pieces, cut into lengths that are powers of two, fill whole bins exactly, so that
at most one sequence of a group is padded by more than ``slack``.

Null texts count as empty: one piece, the end token. Every input row is packed, repeated rows
and null ids too; pieces of equal length are placed by doc_id, start and checksum, and pieces
equal in all may change places. Other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_bpe_path, byte_ids, byte_tokenizer, doc_rows, load, stored

CAPACITY = 2048
GROUP_PIECES = 4096
DEALT_PIECES = 1024
"""Pieces of one document that are dealt together; a longer document is spread over groups."""
SLACK = 0.02
END_ID = 1
PIECE_SCHEMA = "doc_id long, salt long, start long, length long, ids_crc32 long, doc_tokens long, part_crcs array<long>"


class Tournament:
    """Bins by free capacity; each node holds the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Takes room from the leftmost bin that has enough."""
        free, i = self.free, 1
        if free[1] < length:
            raise ValueError("no bin has room")
        while i < self.size:
            i = 2 * i if free[2 * i] >= length else 2 * i + 1
        bin_no = i - self.size
        free[i] -= length
        i >>= 1
        while i:
            top = max(free[2 * i], free[2 * i + 1])
            if free[i] == top:
                break
            free[i] = top
            i >>= 1
        return bin_no


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item."""
    tree = Tournament(len(lengths), capacity)
    bins = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bins[i] = tree.place(lengths[i])
    return bins


def binary_parts(length: int) -> list[int]:
    """The powers of two that make up a length, descending."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pack_pieces(pieces: pd.DataFrame, capacity: int, slack: float) -> pd.DataFrame:
    """Adds bin and offset to a group's pieces; the pieces of badly filled bins come back cut."""
    pieces = pieces.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable").reset_index(drop=True)
    lengths = pieces["length"].to_numpy()
    bins = np.array(first_fit_decreasing(lengths.tolist(), capacity), np.int64)
    fill = np.bincount(bins, lengths).astype(np.int64)
    bad = (fill < capacity * (1 - slack)) & ((fill & (fill - 1)) != 0)
    loose = bad[bins]
    if bad.sum() > 1:
        cut = []
        for row in pieces[loose].itertuples(index=False):
            at = 0
            for part, crc in zip(binary_parts(row.length), row.part_crcs, strict=True):
                cut.append((row.doc_id, row.start + at, part, crc, row.doc_tokens))
                at += part
        cut = pd.DataFrame(cut, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).sort_values("length", ascending=False, kind="stable")
        cut["bin"] = len(fill) + (cut["length"].cumsum() - 1) // capacity
        whole = pieces[~loose].assign(bin=bins[~loose])
        out = pd.concat([whole, cut], ignore_index=True)
    else:
        out = pieces.assign(bin=bins)
    out = out.sort_values("bin", kind="stable")
    out["offset"] = out.groupby("bin")["length"].cumsum() - out["length"]
    return out


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity tokens, with the checksums of their ids and of their power-of-two parts."""
    path = tokenizer_path or byte_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_tokenizer(path)
        salt = TaskContext.get().partitionId() << 32
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*byte_ids(encoding, text.as_py()), END_ID], "<u4")
                salt += 1
                for start in range(0, len(ids), capacity):
                    salt += start > 0 and start % (DEALT_PIECES * capacity) == 0
                    piece = ids[start : start + capacity]
                    at, crcs = 0, []
                    for n in binary_parts(len(piece)):
                        crcs.append(zlib.crc32(piece[at : at + n].tobytes()))
                        at += n
                    for column, x in zip(rows, (doc, salt, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), crcs), strict=True):
                        column.append(x)
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["doc_id", "salt", "start", "length", "ids_crc32", "doc_tokens", "part_crcs"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA)


def pack(docs: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, slack: float = SLACK, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The pieces are written once to the shared folder: their number sets the number of
    groups, which is all that the driver learns. Groups are dealt by a hash of document
    and row, so that one id with very many rows spreads over all groups.
    """
    pieces = stored(token_pieces(docs, capacity, tokenizer_path, id_col, text_col), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_pieces(pdf, capacity, slack)
        out["sequence_id"] = (int(key[0]) << 32) + out["bin"]
        return out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "salt", F.lit(17)), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
