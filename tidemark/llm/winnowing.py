"""Document fingerprints by winnowing.

Every run of ``k`` code points is a gram with a 64-bit rolling hash; of each ``w`` consecutive grams the one with the least
hash is kept, the rightmost of equal ones. Two texts that share ``w + k - 1`` code points share a fingerprint, and its position
says where (the match guarantee). A text with fewer than ``w`` grams is one window; one with fewer than ``k`` code points is one
gram; an empty text has no fingerprint.

Fingerprints of many texts are computed at once over one array of code points: hashes of 2, 4, 8, ... code points from those of
half as many, and minima of windows in the same way. Texts are mapped, not shuffled.

``with_next`` gives each document its successor by descending id without a window over the whole table: ids that exist, at
even quantiles, cut the ids into ranges; the first row of a range also goes to the range before it, so that each text is
shuffled once and every task reads its rows in order, one behind.

Defined results: null text is empty; a null id comes after all others; rows of one id follow each other by their text (null
first); the first row follows the last one, so a single row follows itself; an empty table gives no rows. Likeness is
2 * common / (a + b) over the distinct hashes of two fingerprints, 1 for two empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points of a gram, grams of a window: passages of 23 code points are found.
K, W = 8, 16
#: Code points that one array of texts holds at most, unless one text is longer.
ARRAY = 1 << 21
_base = 0x9E3779B97F4A7C15
FINGERPRINTS = "doc_id long, n_chars long, hashes array<long>, positions array<long>"
_fingerprints = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])
EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_edits = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
Print = tuple[np.ndarray, np.ndarray]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of the k code points from each place on (those with fewer behind them are of no use)."""
    mask = (1 << 64) - 1
    part, size = points.astype(np.uint64) + np.uint64(1), 1  # hash of `size` code points from each place on
    whole, done = None, 0
    while True:
        if k & size:
            whole, done = (part.copy(), size) if whole is None else (_beside(whole, part, done, pow(_base, size, mask + 1)), done + size)
        if done == k:
            break
        part = _beside(part, part, size, pow(_base, size, mask + 1))
        size *= 2
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        whole ^= whole >> np.uint64(shift)
        whole *= np.uint64(factor)
    return whole ^ (whole >> np.uint64(31))


def _beside(left: np.ndarray, right: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hash of ``size`` code points by ``left`` and those behind them by ``right``."""
    out = left * np.uint64(factor)
    out[:-size or None] += right[size:]
    return out


def winnow(texts: list[np.ndarray], k: int = K, w: int = W) -> list[Print]:
    """Hashes and positions of the fingerprints of each text of code points, by position."""
    out: list[Print] = []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= ARRAY:
            size += len(texts[end])
            end += 1
        out += _winnow(texts[at:end], k, w)
        at = end
    return out


def _winnow(texts: list[np.ndarray], k: int, w: int) -> list[Print]:
    sizes = np.array([len(x) for x in texts], np.int64)
    gap = max(k, w)  # zeros between texts, so that no gram and no window reaches the next one
    starts = np.cumsum(sizes + gap) - sizes - gap
    points = np.zeros(int((sizes + gap).sum()), np.uint32)
    for s, x in zip(starts.tolist(), texts):
        points[s : s + len(x)] = x + np.uint32(1)
    n = np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0)
    hashes = grams(points, k)
    gram = np.zeros(len(points) + 1, np.int8)
    np.add.at(gram, starts, 1)
    np.add.at(gram, starts + n, -1)
    hashes[np.cumsum(gram[:-1]) == 0] = np.iinfo(np.uint64).max
    least, where, reach = hashes, np.arange(len(points), dtype=np.int32), 1
    while reach < w:  # minima of windows twice as long, or as long as is left
        step = min(reach, w - reach)
        right = least[step:]
        later = right <= least[:-step]
        least = np.where(later, right, least[:-step])
        where = np.where(later, where[step:], where[: len(where) - step])
        reach += step
    window = np.zeros(len(points) + 1, np.int8)
    np.add.at(window, starts, n > 0)
    np.add.at(window, starts + np.where(n > 0, np.maximum(n - w, 0) + 1, 0), -(n > 0).astype(np.int8))
    chosen = where[np.cumsum(window[:-1])[: len(where)] > 0]
    chosen = chosen[common.runs(chosen)].astype(np.int64)
    cut = np.searchsorted(chosen, np.append(starts, len(points)))
    return [(hashes[chosen[a:b]], chosen[a:b] - s) for a, b, s in zip(cut[:-1].tolist(), cut[1:].tolist(), starts.tolist())]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """2 * common / (a + b) over the distinct hashes of two fingerprints."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) + len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    return 2.0 * int((both[1:] == both[:-1]).sum()) / (len(a) + len(b))


def digest(found: Print, w: int = W) -> str:
    """A fingerprint as text: the first 8 hexadecimal digits of each hash, and the step from the position before it, which is
    at most ``w``, in 2 digits (in 8 from a window of 256 on)."""
    hashes, positions = found
    rows = np.zeros(len(hashes), np.dtype([("hash", ">u4"), ("step", "u1" if w < 256 else ">u4")]))
    rows["hash"], rows["step"] = hashes >> np.uint64(32), np.diff(positions, prepend=0)
    return rows.tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, and the hashes and positions of each document's fingerprint."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [code_points(x or "") for x in batch.column(1).to_pylist()]
            found = winnow(texts, k, w)
            lists = [pa.array([x[j].view(np.int64) for x in found], pa.list_(pa.int64())) for j in (0, 1)]
            yield common.record(_fingerprints, [batch.column(0), [len(x) for x in texts], *lists])

    return common.texts(docs).mapInArrow(find, FINGERPRINTS)


# -- the next document ------------------------------------------------------------------------------------------


def _place(column: Column, heads: Column, count: int) -> Column:
    """The number of the last of the falling ``heads`` that is not below the value, by binary search; null is behind all."""
    steps = [1 << k for k in range(max(count - 1, 0).bit_length() - 1, -1, -1)]
    if not steps:
        return F.lit(0)
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(heads, at + step) >= column, at + step).otherwise(at))
    return F.when(column.isNull(), count - 1).otherwise(found)


def with_next(docs: DataFrame, visit: Callable[[Iterator[tuple[int | None, str, str]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``visit`` over (doc_id, text, text of the next row) of the rows of a range, in order of falling ids. Rows of one id are
    in one range; a task holds two rows at a time."""
    rows = common.texts(docs)
    ranges = common.partitions(docs.sparkSession)
    found = rows.agg(F.percentile_approx("doc_id", [1 - r / ranges for r in range(ranges)], 20 * ranges).alias("heads")).first()["heads"]
    heads = sorted(set(found or []), reverse=True)  # one long for each range
    count, listed = max(len(heads), 1), F.from_json(F.lit(str(heads)), "array<bigint>")
    own = F.struct(F.col("slot"), F.lit(False).alias("behind"))
    before = F.struct(((F.col("slot") + count - 1) % count).cast("int").alias("slot"), F.lit(True).alias("behind"))
    is_head = F.coalesce(F.get(listed, F.col("slot")) == F.col("doc_id"), F.lit(False))
    to = F.explode(F.when(is_head, F.array(own, before)).otherwise(F.array(own)))
    placed = rows.withColumn("slot", _place(F.col("doc_id"), listed, count).cast("int")).select("doc_id", "text", to.alias("to")).select("to.slot", "to.behind", "doc_id", "text")
    dealt = placed.repartitionById(count, "slot").sortWithinPartitions("behind", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        first = last = None
        done = False
        for batch in batches:
            for behind, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("behind", "doc_id", "text"))):
                if not done and last is not None:
                    yield *last, text or ""
                done = done or behind
                first, last = (text or "" if first is None else first), (doc_id, text or "")
        if last is not None and not done:
            yield *last, first

    return dealt.mapInArrow(lambda batches: visit(ordered(batches)), schema)


def compare_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each document's fingerprint, that of its text with the second half overwritten by the next document's start, and how
    alike its fingerprint is to that one and to the next document's."""

    def visit(rows: Iterator[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int | None, str, str]] = []
        size = 0
        for row in rows:
            block.append(row)
            size += len(row[1])
            if size >= ARRAY or len(block) == common.BATCH_ROWS:
                yield compared(block)
                block, size = [], 0
        if block:
            yield compared(block)

    def compared(block: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        halves = [len(t) // 2 for _, t, _ in block]
        edits = [t[: len(t) - h] + n[:h] for (_, t, n), h in zip(block, halves)]
        own = winnow([code_points(t) for _, t, _ in block] + [code_points(block[-1][2])], k, w)
        edited = winnow([code_points(t) for t in edits], k, w)
        return common.record(_edits, [
            [i for i, _, _ in block], [len(t) for _, t, _ in block], [hashlib.sha256(t.encode()).hexdigest() for t in edits], [digest(x, w) for x in own[:-1]], [digest(x, w) for x in edited],
            [likeness(a[0], b[0]) for a, b in zip(own, edited)], [likeness(a[0], b[0]) for a, b in zip(own, own[1:])],
        ])

    return with_next(docs, visit, EDITS)
