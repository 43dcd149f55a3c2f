"""Leading factors of a panel, residuals from them, and peer clusters of symbols by their factor loadings.

The panel stays long: one row for each symbol with the days it has and its values there (a row is bounded by the calendar).
Factors are vectors over days: eigenvectors of the products of days, which are summed over symbols in the task and then by stripes
of days, so that the panel is read once. Only those sums, the square of the calendar (51 MB for ten years), reach the driver, and missing
days count as 0 without being stored. Clusters are found by rounds: centres go out, sums by centre come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store

#: Days of a stripe of products.
STRIPE = 64
#: Symbols among which the starts of clusters are picked, in the order of a hash; rounds of moving centres at most.
POOL, MOVES = 8192, 100
_days = ("days", "values")


def series(rows: DataFrame, value: str, standard: bool = False) -> DataFrame:
    """(symbol, date, value) -> symbol, days (since 1970) and values of its non-null values, stored; if ``standard``, less the
    symbol's mean and over its sample deviation."""
    met = rows.where(F.col(value).isNotNull()).groupBy("symbol", F.unix_date("date").alias("day")).agg(F.avg(value).alias("v"))
    out = met.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("day", "v"))).alias("x"))
    out = out.select("symbol", F.col("x.day").alias("days"), F.col("x.v").alias("values"))
    path = store.scratch(rows.sparkSession, "series")
    (out.mapInArrow(_standard, out.schema) if standard else out).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _scaled(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Values less their owner's mean and over its sample deviation, 1e-8 at least."""
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    away = flat - (np.bincount(owner, flat, n) / size)[owner]
    return away / np.maximum(np.sqrt(np.bincount(owner, away**2, n) / np.maximum(size - 1, 1)), 1e-8)[owner]


def _standard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbol, days, values = batch.columns
        sizes = pa.compute.list_value_length(values).to_numpy()
        scaled = _scaled(values.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), sizes), batch.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(scaled))
        yield pa.RecordBatch.from_arrays([symbol, days, lists], names=["symbol", "days", "values"])


def _parts(batches: Iterator[pa.RecordBatch], calendar: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of so few symbols that their matrix has some millions of cells."""
    rows = max(1, 4_000_000 // max(len(calendar), 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _matrix(batch: pa.RecordBatch, calendar: np.ndarray) -> np.ndarray:
    """Symbols of a batch by days of the calendar; 0 where a symbol has no value."""
    days, values = (batch.column(c) for c in _days)
    sizes = pa.compute.list_value_length(days).to_numpy()
    out = np.zeros((batch.num_rows, len(calendar)))
    out[np.repeat(np.arange(batch.num_rows), sizes), np.searchsorted(calendar, days.flatten().to_numpy())] = values.flatten().to_numpy()
    return out


def factors(panel: DataFrame, k: int, centred: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The calendar, the mean over symbols of each day (0 unless ``centred``), and k orthonormal vectors over days that hold the
    most of the panel's squares."""
    daily = panel.select("symbol", F.explode(F.arrays_zip(*_days)).alias("x")).groupBy("x.days").agg(F.sum("x.values").alias("s")).orderBy("days").collect()  # one row a date
    calendar = np.array([r.days for r in daily], np.int64)
    n = panel.count()
    mean = np.array([r.s for r in daily]) / n if centred and n else np.zeros(len(calendar))
    if not (len(calendar) and n):
        return calendar, mean, np.zeros((len(calendar), 0))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(calendar), len(calendar)))
        for batch in _parts(batches, calendar):
            x = _matrix(batch, calendar) - mean
            total += x.T @ x
        starts = range(0, len(total), STRIPE)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([total[at : at + STRIPE].tobytes() for at in starts])], names=["day", "cells"])

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(cells.as_buffer()) for cells in group["cells"])
        return pa.table({"day": group["day"][:1], "cells": pa.array([total.tobytes()])})

    kind = "day long, cells binary"
    stripes = panel.select(*_days).mapInArrow(products, kind).groupBy("day").applyInArrow(summed, kind).orderBy("day").collect()  # the calendar's square
    found = np.linalg.eigh(np.concatenate([np.frombuffer(r.cells) for r in stripes]).reshape(len(calendar), -1))[1][:, ::-1][:, : min(k, n)]
    sign = np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    return calendar, mean, found * np.where(sign == 0, 1, sign)


def loadings(panel: DataFrame, k: int = 5) -> DataFrame:
    """symbol, load: where each symbol lies along the k directions in which symbols' histories differ most."""
    calendar, mean, vectors = factors(panel, k, centred=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, calendar):
            at = (_matrix(batch, calendar) - mean) @ vectors
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(at), pa.list_(pa.float64()))], names=["symbol", "load"])

    return panel.select("symbol", *_days).mapInArrow(place, "symbol long, load array<double>")


def residuals(rows: DataFrame, value: str, k: int = 5, threshold: float = 2.0) -> DataFrame:
    """symbol, date, residual, z, signal: what k common factors leave of each symbol's standardised values (missing days count as
    its mean), scaled by the symbol; 1 where z is below -threshold, -1 above."""
    panel = series(rows, value, standard=True)
    calendar, _, vectors = factors(panel, k, centred=False)

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, calendar):
            x = _matrix(batch, calendar)
            x -= (x @ vectors) @ vectors.T
            days = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(days).to_numpy())
            flat = x[owner, np.searchsorted(calendar, days.flatten().to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), days.flatten(), pa.array(flat), pa.array(_scaled(flat, owner, batch.num_rows))], names=["symbol", "day", "residual", "z"])

    out = panel.mapInArrow(left, "symbol long, day int, residual double, z double")
    return out.select("symbol", F.date_from_unix_date("day").alias("date"), "residual", "z", F.when(F.col("z") < -threshold, 1).when(F.col("z") > threshold, -1).otherwise(0).alias("signal"))


# -- clusters ---------------------------------------------------------------------------------------------------


def _starts(pool: np.ndarray, k: int) -> np.ndarray:
    """k rows of the pool: the one farthest from the mean, then always the one farthest from those taken."""
    chosen = [int(((pool - pool.mean(0)) ** 2).sum(1).argmax())]
    away = ((pool - pool[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(pool)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((pool - pool[chosen[-1]]) ** 2).sum(1))
    return pool[chosen]


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)


def clusters(points: DataFrame, k: int | None = None) -> DataFrame:
    """(symbol, load) -> symbol, peer_cluster: k-means, k the root of the number of symbols (at least 2) unless given.

    Starts are spread out over at most POOL symbols, taken by a hash, so that no partitioning counts. Labels follow the clusters'
    smallest symbols. At most three symbols are one cluster."""
    spark = points.sparkSession
    path = store.scratch(spark, "points")
    points.write.parquet(path)
    points = spark.read.parquet(path)
    n = points.count()
    if n <= 3:
        return points.select("symbol", F.lit(0).alias("peer_cluster"))
    k = k or min(max(2, int(np.ceil(np.sqrt(n)))), n)
    pool = points.orderBy(F.xxhash64("symbol"), "symbol").limit(max(POOL, k)).collect()
    centres = _starts(np.array([r.load for r in pool]), k)
    width = centres.shape[1]

    def assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            if batch.num_rows:
                at = batch.column("load").flatten().to_numpy().reshape(batch.num_rows, width)
                yield batch, at, _nearest(at, centres)

    for _ in range(MOVES):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centres)), np.zeros(centres.shape)
            for _, at, label in assigned(batches, centres):
                count += np.bincount(label, minlength=len(centres))
                np.add.at(total, label, at)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres))), pa.array(count), *(pa.array(total[:, c]) for c in range(width))], names=["label", "n", *(f"s{c}" for c in range(width))])

        names = ["n", *(f"s{c}" for c in range(width))]
        summed = points.select("load").mapInArrow(sums, "label long, " + ", ".join(f"{c} double" for c in names)).groupBy("label").agg(*(F.sum(c).alias(c) for c in names)).orderBy("label").collect()  # one row a cluster
        found = np.array([[r[c] for c in names] for r in summed])
        moved = np.where(found[:, :1] > 0, found[:, 1:] / np.maximum(found[:, :1], 1), centres)
        if np.allclose(moved, centres, rtol=0, atol=1e-12 * (1 + np.abs(centres).max())):
            break
        centres = moved

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in assigned(batches, centres):
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), pa.array(found)], names=["symbol", "label"])

    labelled = points.mapInArrow(label, "symbol long, label long")
    first = labelled.groupBy("label").agg(F.min("symbol").alias("_first"))  # one row a cluster
    from pyspark.sql.window import Window

    order = first.select("label", (F.row_number().over(Window.orderBy("_first")) - 1).alias("peer_cluster"))
    return labelled.join(F.broadcast(order), "label").select("symbol", "peer_cluster")


def peer_clusters(rows: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """symbol, peer_cluster of symbols with similar histories: k-means on their loadings on five factors."""
    return clusters(loadings(series(rows, value)), k)
