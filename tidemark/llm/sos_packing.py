"""Packing by sum of squares: pieces of documents go into sequences of a fixed capacity.

Each document's ids (with an end id) are cut only if they exceed the capacity; its first piece may be shorter. A full
piece is a sequence of its own. Every other piece goes to the open sequence whose choice leaves the smallest sum, over
all residual gaps, of the squared number of open sequences with that gap. Only ids and lengths are shuffled: groups of
about ``GROUP`` pieces, by a hash of the piece, are packed side by side; what each group leaves in sequences that are
not full is packed again in groups of that size, so the loss does not add up over the groups.

Defined results: null text is empty (the end id alone); repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

CAPACITY, GROUP = 1024, 40_000
#: A sequence with at most so large a gap is final after the first pass.
CLOSED = 0
_pieces = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with the crc32 of its ids (unsigned 32 bits, little-endian)."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, stop = encoder("byte", vocabulary), np.array([end], "<u4").tobytes()
        for batch in rows:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tok.encode(common.as_bytes(batch.column(1))), strict=True):
                data = memoryview(ids.astype("<u4").tobytes() + stop)
                n = len(data) // 4
                first = n % capacity or min(n, capacity)
                cuts = [0, *range(first, n + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield common.record(_pieces, list(zip(*out)) if out else [[]] * 5)

    return common.texts(docs).mapInArrow(task, PIECES)


def place(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each length, in the given order, by the sum-of-squares rule; ties go to the smallest gap left.

    Placing s into a gap g takes one from N(g) and adds one to N(g - s), which changes the sum of squares by
    2 (N(g - s) - N(g)) + 2, or 1 - 2 N(g) if it fills the gap; a new bin adds 2 N(capacity - s) + 1.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = [], 0
    for s in lengths:
        change = 2 * (count[: capacity - s + 1] - count[s:]) + 2  # by the gap that is left
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = 1 << 40
        change[capacity - s] = 2 * count[capacity - s] + 1 if s < capacity else 1
        left = int(np.argmin(change))
        if left == capacity - s:
            b, bins = bins, bins + 1
        else:
            count[left + s] -= 1
            b = open_bins[left + s].pop()
        if left:
            count[left] += 1
            open_bins[left].append(b)
        out.append(b)
    return out


def _group(pass_no: int, capacity: int):
    """Pack one group; bins get numbers that no other group has."""

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["start"].to_numpy(), rows["doc_id"].to_numpy(zero_copy_only=False), -rows["length"].to_numpy()))
        rows = rows.take(pa.array(order))
        length = rows["length"].to_numpy()
        bins = np.array(place(length.tolist(), capacity), np.int64)
        by = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[by])
        begin = common.runs(bins[by])
        base = np.repeat(np.concatenate([[0], ends[begin[1:] - 1]]) if len(begin) else np.zeros(0, np.int64), np.diff(np.append(begin, len(by))))
        offset = np.empty(len(by), np.int64)
        offset[by] = ends - length[by] - base
        fill = np.bincount(bins, length, minlength=1)
        group = int(key[0].as_py())
        number = ((group * 3 + pass_no) << 32) + bins
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("gap", pa.array((capacity - fill[bins]).astype(np.int64)))

    return task


def _grouped(rows: DataFrame, count: int, pass_no: int, size: int, capacity: int) -> DataFrame:
    groups = max(1, -(-count // size))
    # The row's place in the stored table parts rows that are repeated.
    keyed = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return keyed.groupBy("group").applyInArrow(_group(pass_no, capacity), PACKED + ", gap long")


def packed(cut_pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """sequence_id and offset of each piece; ``cut_pieces`` should be stored, as it is read more than once."""
    full = cut_pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut_pieces.where(F.col("length") < capacity)
    first = common.cut(_grouped(rest, rest.count(), 0, group, capacity), "packed")
    loose = first.where(F.col("gap") > CLOSED).select(*cut_pieces.columns)
    second = _grouped(loose, loose.count(), 1, group, capacity)
    return full.unionByName(first.where(F.col("gap") <= CLOSED).drop("gap")).unionByName(second.drop("gap"))


def pack(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    return packed(common.cut(pieces(docs, vocabulary, end, capacity), "pieces"), capacity, group)
