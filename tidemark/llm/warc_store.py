"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id. The ranges follow from the pages alone, not from the session: their number from the
bytes of all payloads, their bounds from the page ids with the smallest hashes. A range is written into archives that
roll by compressed size, one gzip member a record, under temporary names; its manifest rows (name, records, bytes, checksum) are stored with the job's
commit, and a reader opens only archives that the manifest lists, with the checksum it gives. Headers, record ids and
digests are made anew from the payload; dates are a parameter, so equal input gives equal bytes. Of equal payloads the
record with the smallest page id is a response, the others are revisits that refer to it. That is found on digests alone:
each page's reference travels to its record in the same sort, so payloads are shuffled once and no group of copies meets.

Defined results: null html is an empty payload; a null url gets a urn of the page; a null page id sorts first and is the
response only if no page with an id has the payload; of repeated rows the first is the response; an empty table gives no
archive and no rows; control characters in urls are percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Compressed bytes of an archive, and the level of compression.
ROLL, LEVEL = 16 << 20, 5
#: Payload bytes of a range, and page ids that its bounds are found in.
RANGE, SAMPLE = 16 << 20, 20_000
#: Pages of one payload from which their reference comes from a list instead of a shuffle.
HOT, BROADCAST_ROWS = 10_000, 1_000_000
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "part int, seq int, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_records = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _uri(url: str | None, page_id: int | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"


def _member(kind: str, rid: str, headers: list[tuple[str, object]], block: bytes, date: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, first: int | None, nth: int, date: str = DATE) -> bytes:
    """The gzip member of a page's response or revisit."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers: list[tuple[str, object]] = [("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", f"sha1:{own}"), ("Content-Type", "application/http; msgtype=response")]
    headers += [("X-Page-ID", page_id)] * (page_id is not None)
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, own, 0))]
        headers += [("X-Refers-To-Page-ID", first)] * (first is not None)
    return _member("revisit" if revisit else "response", record_id(page_id, own, nth), headers, http if revisit else http + payload, date)


def bounds(pages: DataFrame, size: int = RANGE, sample: int = SAMPLE) -> list[float]:
    """Where ranges of about ``size`` payload bytes begin: the same for equal pages, however they are stored.

    They are quantiles of about ``sample`` distinct page ids, those with a hash below a share that the ids' number gives.
    """
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html").cast("long") + 100), F.lit(0)).alias("n")).first()["n"]
    ranges = -(-total // size) or 1
    if ranges == 1:
        return []
    ids = common.cut(pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id")).distinct(), "page-ids")
    share = sample / max(ids.count(), 1)
    some = ids.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) < F.lit(share * (1 << 40))).select(F.col("page_id").cast("double").alias("x"))
    xs = np.sort(some.toArrow()["x"].to_numpy())
    return sorted({float(xs[k * len(xs) // ranges]) for k in range(1, ranges)}) if len(xs) else []


def references(slim: DataFrame) -> DataFrame:
    """page_id, digest, first: for each page and digest that several pages have, the smallest page id of them."""
    copied = common.cut(slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copied")
    # A payload that very many pages share is no join key: such payloads are at most a HOT-th of the pages.
    hot = common.small(copied.where(F.col("n") >= HOT).select("digest", "first"), BROADCAST_ROWS)
    light = copied.where(F.col("n") < HOT).select("digest", "first")
    found = slim.join(hot, "digest").unionByName(slim.join(hot.select("digest"), "digest", "left_anti").join(light, "digest"))
    return found.select("page_id", "digest", "first").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0, roll: int = ROLL, date: str = DATE, size: int = RANGE) -> DataFrame:
    """Write all pages; returns the manifest, stored in ``folder``. Equal pages give equal archives."""
    spark = pages.sparkSession
    common.batches(spark)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html")).select("page_id", "url", html.alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    slim = common.cut(keyed.where(F.length("payload") >= least_bytes).select("page_id", "digest"), "digests")
    # A page's reference comes before its record: one row for each page and digest that has copies.
    both = keyed.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first")).unionByName(references(slim).select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first"))
    inner = bounds(pages, size)
    ranged = both.withColumn("part", F.lit(0))
    if inner:
        place = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="at", outputCol="range")
        ranged = place.transform(both.withColumn("at", F.coalesce(F.col("page_id").cast("double"), F.lit(-float("inf"))))).withColumn("part", F.col("range").cast("int"))
    ordered = ranged.repartitionById(len(inner) + 1, "part").sortWithinPartitions("part", "page_id", "digest", "kind", "url").select("part", "page_id", "digest", "kind", "url", "payload", "first")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, records = -1, 0, 0
        archive = bytearray()

        def close() -> pa.RecordBatch:
            nonlocal seq, records
            data, name = bytes(archive), f"part-{part:06d}-{seq:06d}.warc.gz"
            common.put(folder, name, data)
            out = common.record(_manifest, [[part], [seq], [name], [records], [len(data)], [hashlib.sha256(data).hexdigest()]])
            archive.clear()
            seq, records = seq + 1, 0
            return out

        key, ref, nth = None, None, 0
        for batch in batches:
            for own, page_id, sha, kind, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part:
                    if archive:
                        yield close()
                    part, seq = own, 0
                if (page_id, sha) != key:
                    key, ref, nth = (page_id, sha), None, 0
                if kind == 0:
                    ref = (first,)
                    continue
                revisit = ref is not None and (ref[0] != page_id or nth > 0)
                member = page_record(page_id, url, payload, revisit, ref[0] if ref else None, nth, date)
                nth += 1
                if archive and len(archive) + len(member) > roll:
                    yield close()
                if not archive:
                    info = json.dumps({"format": "WARC/1.1", "part": part}, sort_keys=True).encode()
                    archive += _member("warcinfo", record_id("info", part, seq), [("Content-Type", "application/json")], info, date)
                archive += member
                records += 1
        if archive:
            yield close()

    ordered.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/_manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member."""
    at, view = 0, memoryview(data)
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a member")
            piece = view[at : at + 65536]
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each response and revisit in the archives of the manifest; checksums and digests are verified."""
    common.batches(spark)
    listed = manifest(spark, folder).select("name", "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    whole = files.join(listed, "name").select("content", "sha256")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, sha in zip(*batch.columns, strict=True):
                data, out = content.as_py(), []
                if hashlib.sha256(data).hexdigest() != sha.as_py():
                    raise ValueError("an archive differs from its manifest")
                for headers, block in map(parse, members(data)):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    stated = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or digest(payload) != stated):
                        raise ValueError("a payload differs from its digest")
                    own, to = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    out.append((own and int(own), headers["warc-target-uri"], size, stated, kind, to and int(to)))
                yield common.record(_records, list(zip(*out)) if out else [[]] * len(_records))

    return whole.mapInArrow(task, RECORDS)
