"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

1. Spark splits the texts: each task cuts its documents into blocks and deals each block's distinct words into buckets by
   a hash of the word.
2. By bucket, the lists of all blocks meet. Each distinct word is encoded once, and every block gets the ids of its words
   back in the order of its list.
3. By block, documents (as ranks of their words by frequency in the block) and ids meet, and ids take the words' places.
   Decoding looks up the piece of each id in the broadcast vocabulary (its size is the tokenizer's) and joins the pieces
   as the library does without a decoder.

Texts are split once for the lists and once for the documents, so that only compressed lists, ids and ranks are ever
written; a checksum of each list proves that both passes cut the same blocks. A word that occurs anywhere is in a block's
list once, so frequent words make no bucket hot.

Defined results: null text is empty and has no ids; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder

#: Distinct words, and positions, at which a block is closed; documents of one stored row.
BLOCK_WORDS, BLOCK_POSITIONS, ROW_POSITIONS = 200_000, 5_000_000, 1_000_000
#: Distinct words of a bucket that a worker keeps. Buckets are as many as shuffle partitions, so a session that has enough of
#: them for its input stays far below.
KNOWN = 2_000_000
_split = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
SPLIT = "block long, bucket int, payload binary"
_replies = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS = "doc_id long, ids array<int>, decoded string"


def _squeeze(*parts: bytes) -> bytes:
    """Parts with their lengths, compressed."""
    sizes = np.array([len(parts), *map(len, parts)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def _parts(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    ends = np.cumsum([8 * (n + 1), *np.frombuffer(raw, "<u8", n, 8).astype(np.int64).tolist()]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def split(docs: DataFrame, buckets: int, lists: bool) -> DataFrame:
    """For each block its word lists (bucket >= 0), or the ranks of its words (bucket -2) and its documents (bucket -1)."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import WordEncoder

        part, block, held = TaskContext.get().partitionId(), 0, 0
        words: dict[bytes, int] = {}
        ids: list = []
        docs: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            number = (part << 24) + block
            by: list[list[bytes]] = [[] for _ in range(buckets)]
            for w in words:
                by[zlib.crc32(w) % buckets].append(w)
            for own in by:
                own.sort()
            joined = [b" ".join(own) for own in by]
            if lists:
                keep = [b for b in range(buckets) if by[b]]
                yield common.record(_split, [[number] * len(keep), keep, [_squeeze(joined[b]) for b in keep]])
                return
            # The place in the lists of each word by falling frequency; documents hold frequency ranks, which are small.
            place = np.fromiter((words[w] for own in by for w in own), np.int64, len(words))
            flat = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
            often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            at, rank = np.empty(len(words), "<u4"), np.empty(len(words), "<u4")
            at[place] = np.arange(len(words))
            rank[often] = np.arange(len(words))
            crc = np.array([zlib.crc32(x) for x in joined], "<u4")
            yield common.record(_split, [[number], [-2], [_squeeze(at[often].view("u1").reshape(-1, 4).T.tobytes(), crc.tobytes())]])
            start = 0
            while start < len(docs):
                end, size = start, 0
                while end < len(docs) and (end == start or size + len(docs[end]) <= ROW_POSITIONS):
                    size += len(docs[end])
                    end += 1
                some = ids[start:end]
                ranks = rank[np.concatenate(docs[start:end])]
                yield common.record(_split, [[number], [-1], [_squeeze(np.array([x or 0 for x in some], "<i8").tobytes(), np.array([x is None for x in some], "u1").tobytes(), np.array([len(x) for x in docs[start:end]], "<u8").tobytes(), ranks.view("u1").reshape(-1, 4).T.tobytes())]])
                start = end

        for batch in rows:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                found = WordEncoder.split(text)
                for w in sorted(set(found).difference(words)):
                    words[w] = len(words)
                if not lists:
                    ids.append(doc_id)
                    docs.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                held += len(found)
                if held >= BLOCK_POSITIONS or len(words) >= BLOCK_WORDS:
                    yield from close()
                    block, held = block + 1, 0
                    words.clear()
                    ids.clear()
                    docs.clear()
        if words or docs:
            yield from close()

    return common.texts(docs).mapInArrow(task, SPLIT)


def encode_lists(lists: DataFrame, vocabulary: str, buckets: int) -> DataFrame:
    """Each bucket's distinct words are encoded once; a row for each block and bucket: id counts, ids, the list's checksum."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known, bucket = encoder("word", vocabulary), {}, None
        for batch in rows:
            out: list[tuple] = []
            for block, b, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != bucket:
                    known, bucket = {}, b  # rows are sorted by bucket
                (joined,) = _parts(payload)
                words = joined.split(b" ")
                if len(known) > KNOWN:  # a word that comes again is then encoded again
                    known = {}
                if new := [w for w in words if w not in known]:
                    known.update(zip(new, (x.tobytes() for x in tok.encode_words(new)), strict=True))
                ids = [known[w] for w in words]
                counts = np.array([len(x) for x in ids], np.int64) // tok.kind.itemsize
                out.append((block, b, _squeeze(counts.astype("<u4").tobytes(), b"".join(ids), np.array([zlib.crc32(joined)], "<u4").tobytes())))
            yield common.record(_replies, list(zip(*out)) if out else [[]] * 3)

    dealt = lists.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(task, SPLIT)


def assemble(documents: DataFrame, replies: DataFrame, vocabulary: str, out: str) -> DataFrame:
    """Put ids in the words' places; ``out`` is DIGESTS or IDS."""
    digests = out == DIGESTS
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder("word", vocabulary)
        if tok.tok.decoder is not None:
            raise ValueError("this vocabulary has a decoder, so its pieces are not joined by spaces")
        pieces = [(tok.tok.id_to_token(i) or "").encode() for i in range(tok.size)]
        decimals = [b"%d" % i for i in range(tok.size)]
        block, lists, ready = None, [], None

        def table(order: bytes, sums: bytes) -> tuple:
            """For each rank: count of ids, and the ids in decimal and as pieces, joined by spaces."""
            crc = {b: int(c) for b, c in enumerate(np.frombuffer(sums, "<u4"))}
            numbers, names, raw, counts = [], [], [], []
            for b, sizes, ids, own in lists:
                if crc.pop(b) != own:
                    raise ValueError("the documents were read in another order than their words")
                start, ids = 0, ids.tolist()
                counts.append(sizes)
                for size in sizes.tolist():
                    some = ids[start : start + size]
                    start += size
                    numbers.append(b" ".join([decimals[i] for i in some]))
                    names.append(b" ".join([pieces[i] for i in some]))
                    if not digests:
                        raw.append(some)
            if any(c != zlib.crc32(b"") for c in crc.values()):
                raise ValueError("a list of words is missing")
            at = np.frombuffer(order, "u1").reshape(4, -1).T.copy().view("<u4")[:, 0].tolist() if order else []
            count = np.concatenate(counts)[at] if at else np.zeros(0, np.int64)
            return count, [numbers[k] for k in at], [names[k] for k in at], [raw[k] for k in at] if raw else raw

        for batch in rows:
            got: list[tuple] = []
            for b, bucket, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != block:
                    block, lists, ready = b, [], None
                parts = _parts(payload)
                if bucket >= 0:
                    lists.append((bucket, np.frombuffer(parts[0], "<u4").astype(np.int64), np.frombuffer(parts[1], tok.kind), int(np.frombuffer(parts[2], "<u4")[0])))
                    continue
                if bucket == -2:
                    ready, lists = table(*parts), []
                    continue
                count, numbers, names, raw = ready
                holes = bool((count == 0).any())
                sizes = np.frombuffer(parts[2], "<u8").astype(np.int64)
                flat = np.frombuffer(parts[3], "u1").reshape(4, -1).T.copy().view("<u4")[:, 0] if parts[3] else np.zeros(0, np.uint32)
                start = 0
                for doc_id, null, size in zip(np.frombuffer(parts[0], "<i8").tolist(), parts[1], sizes.tolist(), strict=True):
                    own = flat[start : start + size]
                    start += size
                    if holes:
                        own = own[count[own] > 0]
                    at = own.tolist()
                    decoded = b" ".join([names[k] for k in at])
                    if digests:
                        got.append((None if null else doc_id, int(count[own].sum()), hashlib.sha256(b" ".join([numbers[k] for k in at])).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                    else:
                        got.append((None if null else doc_id, [i for k in at for i in raw[k]], decoded.decode()))
            yield common.record(schema, list(zip(*got)) if got else [[]] * len(schema))

    both = documents.unionByName(replies)
    met = both.repartition(common.partitions(documents.sparkSession), "block").sortWithinPartitions("block", F.col("bucket") < 0, "bucket")
    return met.mapInArrow(task, out)


def encode_decode(docs: DataFrame, vocabulary: str, out: str = DIGESTS, buckets: int | None = None) -> DataFrame:
    """Ids and decoded text of every document, or (the default) their counts and digests."""
    spark = docs.sparkSession
    buckets = buckets or common.partitions(spark)
    replies = encode_lists(split(docs, buckets, lists=True), vocabulary, buckets)
    return assemble(split(docs, buckets, lists=False), replies, vocabulary, out)
