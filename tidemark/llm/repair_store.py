"""Token ids in shard files compressed by a Re-Pair grammar, readable document by document.

Documents are range-partitioned and sorted by id; every task writes its range as shards of about ``SHARD`` ids under
temporary names and reports one manifest row for each. A shard holds its own grammar: in each round the most frequent
pairs of neighbouring symbols become nonterminals (left to right, never across documents), until no pair occurs ``LEAST``
times. Symbols have as many bits as the vocabulary and the rules need. Stored are the rules, the expansion length of each
nonterminal, the symbols of all documents, and for each document where its symbols end.

Defined results: null text is empty; a null id sorts first; repeated ids follow each other, ordered by a hash of the
text; an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Ids in a shard, nonterminals of a round, and the count from which a pair is worth a rule.
SHARD, PER_ROUND, LEAST = 1 << 20, 4000, 4
MAGIC = b"REPAIR02"
_schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def compress(ids: np.ndarray, last: np.ndarray, base: int, per_round: int = PER_ROUND, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their end-of-document flags, and the rules (pairs of symbols; rule k is the symbol base + k)."""
    seq, last, rules, count = ids.astype(np.uint32), last.copy(), [], 0
    # Once a round has taken all frequent pairs, only pairs with symbols of that round can be frequent. A full count ends it.
    fresh_from = 0
    while len(seq) > 1:
        # Pairs are numbers of 32 bits as long as symbols have 16, then of 64.
        shift, kind, factor = (16, np.uint32, 2654435761) if base + count <= 1 << 16 else (32, np.uint64, 0x9E3779B97F4A7C15)
        keys = seq[:-1].astype(kind) << kind(shift) | seq[1:]
        inner = ~last[:-1]
        if fresh_from:
            inner &= np.maximum(seq[:-1], seq[1:]) >= fresh_from
        ordered = np.sort(keys[inner])
        starts = common.runs(ordered)
        counts = np.diff(np.append(starts, len(ordered)))
        good = np.flatnonzero(counts >= least)
        if not len(good):
            if not fresh_from:
                break
            fresh_from = 0
            continue
        whole = len(good) <= per_round
        if not whole:
            good = good[np.argsort(-counts[good], kind="stable")[:per_round]]
        pairs = ordered[starts[good]]
        # A table of 2^20 slots finds the chosen pairs; of two in one slot the later waits for the next round.
        slot = lambda x: (x * kind(factor)) >> kind(2 * shift - 20)
        lookup = np.zeros(1 << 20, np.int32)
        lookup[slot(pairs[::-1])] = np.arange(len(pairs), 0, -1, dtype=np.int32)
        found = lookup[slot(keys)] - 1
        hit = (found >= 0) & (pairs[found] == keys) & inner
        # Of overlapping hits the first, third, ... are taken.
        at = np.flatnonzero(hit)
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        times = np.bincount(found[at], minlength=len(pairs))
        used = times > 0
        number = np.cumsum(used) - 1
        rules.append(np.stack([pairs[used] >> kind(shift), pairs[used] & kind((1 << shift) - 1)], 1).astype(np.uint32))
        seq[at] = (base + count + number[found[at]]).astype(np.uint32)
        fresh_from = base + count if whole else 0
        count += int(used.sum())
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def squeeze(symbols: np.ndarray, width: int) -> bytes:
    """The low 16 bits of each symbol, then the bits above them."""
    low = symbols.astype(np.uint32)
    high = (low[:, None] >> np.arange(16, width, dtype=np.uint32)) & np.uint32(1)
    return (low & np.uint32(0xFFFF)).astype("<u2").tobytes() + np.packbits(high.astype(np.uint8).ravel()).tobytes()


def spread(data: memoryview, count: int, width: int) -> tuple[np.ndarray, int]:
    """The symbols that ``squeeze`` wrote, and the bytes that they take."""
    out = np.frombuffer(data, "<u2", count).astype(np.int64)
    extra = max(width - 16, 0)
    size = -(-count * extra // 8)
    if extra and count:
        bits = np.unpackbits(np.frombuffer(data, "u1", size, 2 * count), count=count * extra).reshape(count, extra)
        out += bits.astype(np.int64) @ (1 << np.arange(16, width, dtype=np.int64))
    return out, 2 * count + size


def levels(rules: np.ndarray, base: int) -> list[np.ndarray]:
    """The rules in an order in which each one's symbols come first: by height."""
    todo = np.arange(len(rules))
    out: list[np.ndarray] = []
    done = np.zeros(base + len(rules), bool)
    done[:base] = True
    while len(todo):
        ready = done[rules[todo, 0]] & done[rules[todo, 1]]
        out.append(todo[ready])
        done[base + out[-1]] = True
        todo = todo[~ready]
    return out


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """The number of ids that each nonterminal stands for."""
    size = np.ones(base + len(rules), np.int64)
    for k in levels(rules, base):
        size[base + k] = size[rules[k, 0]] + size[rules[k, 1]]
    return size[base:].astype("<u4")


def expansions(rules: np.ndarray, base: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all symbols one after another, and where each symbol's begin (symbols, then rules); ``sizes``: of each rule."""
    size = np.concatenate([np.ones(base, np.int64), sizes])
    where = np.concatenate([[0], np.cumsum(size)])
    flat = np.arange(where[-1], dtype=np.uint32)
    for k in levels(rules, base):
        for side, shift in ((0, 0), (1, size[rules[k, 0]])):
            part = rules[k, side]
            n = size[part]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(where[base + k] + shift, n) + step] = flat[np.repeat(where[part], n) + step]
    return flat, where


def pack(part: int, seq: int, start: int, doc_ids: list, docs: list[np.ndarray], base: int) -> bytes:
    """A shard file. Symbols and rules have as many bits as the vocabulary and the rules need, 16 at least."""
    ids = np.concatenate(docs)
    sizes = np.array([len(x) for x in docs], np.int64)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    symbols, ends, rules = compress(ids, last, base)
    width = max(16, int(base + len(rules) - 1).bit_length())
    head = {"part": part, "seq": seq, "start": start, "documents": len(docs), "ids": len(ids), "rules": len(rules), "symbols": len(symbols), "base": base, "width": width}
    text = json.dumps(head, sort_keys=True).encode()
    body = [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1"), (np.flatnonzero(ends) + 1).astype("<u8"), sizes.astype("<u8"), lengths(rules, base)]
    return MAGIC + struct.pack("<I", len(text)) + text + b"".join(x.tobytes() for x in body) + squeeze(rules.ravel(), width) + squeeze(symbols, width)


class Shard:
    """A shard file's content; ``document(k)`` decodes one document without touching the others, ``span`` a part of one."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        (n,) = struct.unpack("<I", data[8:12])
        self.head = h = json.loads(data[12 : 12 + n])
        at, view = 12 + n, memoryview(data)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        d = h["documents"]
        ids, null = take("<i8", d), take("u1", d)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.ends, self.sizes = take("<u8", d).astype(np.int64), take("<u8", d).astype(np.int64)
        self.lengths = take("<u4", h["rules"]).astype(np.int64)
        rules, used = spread(view[at:], 2 * h["rules"], h["width"])
        self.rules = rules.reshape(-1, 2)
        self.symbols, _ = spread(view[at + used :], h["symbols"], h["width"])
        self._flat: tuple | None = None

    def symbols_of(self, k: int) -> np.ndarray:
        return self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]

    def document(self, k: int) -> np.ndarray:
        if self._flat is None:
            self._flat = expansions(self.rules, self.head["base"], self.lengths)
        flat, where = self._flat
        symbols = self.symbols_of(k)
        begin, size = where[symbols], where[symbols + 1] - where[symbols]
        total = int(size.sum())
        step = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return flat[step + np.arange(total)]

    def span(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k: the stored lengths skip what lies before, and only rules that reach into the span unfold."""
        base, lengths, symbols = self.head["base"], self.lengths, self.symbols_of(k)
        size = np.ones(len(symbols), np.int64)
        size[symbols >= base] = lengths[symbols[symbols >= base] - base]
        ends = np.cumsum(size)
        start, stop = max(start, 0), min(stop, int(ends[-1]))
        first = int(np.searchsorted(ends, start, side="right"))
        out: list[int] = []
        at = int(ends[first - 1]) if first else 0
        stack = [int(x) for x in symbols[first : int(np.searchsorted(ends, stop, side="left")) + 1][::-1]]
        while stack and at < stop:
            x = stack.pop()
            n = int(lengths[x - base]) if x >= base else 1
            if at + n <= start:
                at += n
            elif x >= base:
                stack += [int(self.rules[x - base, 1]), int(self.rules[x - base, 0])]
            else:
                out.append(x)
                at += 1
        return np.array(out, np.uint32)


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = 1, shard: int = SHARD) -> DataFrame:
    """Encode, append ``end`` to every document, and write shards in ascending doc_id order; returns the manifest, stored in ``folder``."""
    spark = docs.sparkSession
    rows = common.texts(docs).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(common.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = encoder("word", vocabulary), TaskContext.get().partitionId()
        seq = start = held = 0
        ids: list = []
        docs: list[np.ndarray] = []
        stop = np.array([end], np.uint32)

        def roll() -> pa.RecordBatch:
            nonlocal seq, start, held
            data = pack(part, seq, start, ids, docs, tok.size)
            name = f"part-{part:06d}-{seq:06d}.rp"
            common.put(folder, name, data)
            out = common.record(_schema, [[part], [seq], [name], [len(docs)], [held], [len(data)]])
            seq, start, held = seq + 1, start + held, 0
            ids.clear()
            docs.clear()
            return out

        for batch in rows:
            for doc_id, found in zip(batch.column(0).to_pylist(), tok.encode(common.as_bytes(batch.column(1))), strict=True):
                ids.append(doc_id)
                docs.append(np.concatenate([found, stop]))
                held += len(docs[-1])
                if held >= shard:
                    yield roll()
        if docs:
            yield roll()

    found = ranged.mapInArrow(task, "part int, seq int, name string, documents long, ids long, bytes long")
    found.write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, seq int, name string, documents long, ids long, bytes long").parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str, columns: str = "doc_id long, start long, n_tokens long, ids_crc32 long") -> DataFrame:
    """The documents of all shards that the manifest lists: id, ids before it, number of ids, and their crc32 or ids.

    ``start`` needs the ids of earlier ranges: one sum for each task of the writer goes to the driver.
    """
    sums = {r["part"]: r["n"] for r in manifest(spark, folder).groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]
    common.batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rp").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    whole = files.join(manifest(spark, folder).select("name"), "name", "left_semi").select("content") if sums else files.select("content")
    with_ids = "array" in columns
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())) if with_ids else ("ids_crc32", pa.int64())])

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for value in batch.column(0):
                shard = Shard(value.as_py())
                starts = before[shard.head["part"]] + shard.head["start"] + np.concatenate([[0], np.cumsum(shard.sizes)[:-1]])
                if with_ids:
                    last = [shard.document(k).tolist() for k in range(len(starts))]
                else:
                    last = [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(len(starts))]
                yield common.record(schema, [shard.doc_ids, starts, shard.sizes, last])

    return whole.mapInArrow(task, columns)


def with_ids(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read``, with the ids themselves."""
    return read(spark, folder, "doc_id long, start long, n_tokens long, ids array<long>")
