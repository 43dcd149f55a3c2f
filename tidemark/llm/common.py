"""What the corpus operators share: scratch storage, table access and Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows that one Arrow batch carries to a Python worker; bounds a worker's memory.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000

_own_dir: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``. Where that is unset, a folder of this process, if no other machine takes part."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = _own_dir.setdefault("dir", tempfile.mkdtemp(prefix="spark-tidemark-"))
    if "://" not in base:
        base = "file://" + os.path.abspath(base.removeprefix("file:"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: ends its lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes and rows; documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id BIGINT and text of every row; other columns are not read."""
    batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))


def texts_of(docs: DataFrame) -> DataFrame:
    """As ``texts``, for rows that are already chosen."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def free(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores before them until none is a column's."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int) -> DataFrame:
    """A stored table marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


def crc_mod(column, modulus: int):
    """crc32 of the id written in decimal, modulo ``modulus``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- files in shared storage, from executors -------------------------------------------------------------------


def storage(uri: str):
    """The Arrow file system of a folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(folder: str, name: str, data: bytes) -> None:
    """Write under a temporary name, then rename: a reader sees a whole file or none; a retried task writes the same."""
    where, path = storage(folder)
    where.create_dir(path, recursive=True)
    partial = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(partial) as out:
        out.write(data)
    where.move(partial, f"{path}/{name}")


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
