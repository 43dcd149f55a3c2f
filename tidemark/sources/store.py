"""Stored panel tables: partitioned domains, idempotent inserts, keyed updates, results cached by configuration, ledgers."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which all executors share; where that is unset, and no other machine takes
    part, one of this process."""
    master = spark.conf.get("spark.master", "")
    if not spark.conf.get("spark.checkpoint.dir", None) and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-tidemark-"))
    base = base if "://" in base else "file://" + os.path.abspath(base.removeprefix("file:"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_domain(rows: DataFrame, path: str, mode: str = "append", by: str = "date") -> None:
    """Append rows to a domain with a folder for each value of ``by``; overwriting replaces only the values that the rows have."""
    rows.repartition(by).write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode(mode).parquet(path)


def load_domain(spark: SparkSession, path: str, schema: StructType, start: str | None = None, end: str | None = None, symbols: list | None = None, years: bool = False) -> DataFrame:
    """A slice of a domain saved by date (or by ``year``, if ``years``): dates prune folders, symbols are pushed to the scan."""
    rows = spark.read.schema(schema).parquet(path)
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
        rows = rows.where(F.col("year") >= int(start[:4])) if years else rows
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
        rows = rows.where(F.col("year") <= int(end[:4])) if years else rows
    return rows.where(F.col("symbol").isin(symbols)) if symbols else rows


def available(rows: DataFrame) -> DataFrame:
    return rows.select("date", "symbol").distinct()


def read_any(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet, CSV with a header, or JSON lines by the name's ending; malformed lines are dropped."""
    kind = path.rsplit(".", 1)[-1]
    reader = spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return reader.option("mode", "DROPMALFORMED").json(path) if kind in ("json", "jsonl") else reader.parquet(path)


def snapshot(depth: DataFrame, at: Column, levels: int) -> DataFrame:
    """The latest snapshot at or before ``at`` of each symbol, first levels: one aggregate, joined back."""
    before = depth.where(F.col("ts") <= at)
    latest = before.groupBy("symbol").agg(F.max("ts").alias("ts"))
    return before.join(latest, ["symbol", "ts"]).where(F.col("level") <= levels)


def article_id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)


def article_key(title: str, source: str, date: str) -> Column:
    """The id of an article: its title without white space around it and its source, both in lower case, and the day."""
    blank = "[ \\t\\n\\r\\f\\x0B]+"
    whole = F.regexp_replace(F.regexp_replace(F.lower(title), f"^{blank}", ""), f"{blank}\\z", "")
    return F.sha2(F.concat_ws("|", F.coalesce(whole, F.lit("")), F.coalesce(F.lower(source), F.lit("")), F.coalesce(F.col(date).cast("string"), F.lit(""))), 256)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet; within them the first of each key by all columns."""
    from pyspark.sql.window import Window

    once = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*incoming.columns))).where("_n = 1").drop("_n")
    return once.join(existing.select(key), key, "left_anti")


def update(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` takes the value of ``changes`` where that has the key."""
    new = changes.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def cached(spark: SparkSession, folder: str, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The result for a configuration: written once under the hash of the configuration, then read."""
    path = f"{folder}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
