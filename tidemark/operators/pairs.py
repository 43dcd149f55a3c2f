"""Statistics of all pairs of symbols of a cluster, by tiles of two blocks of symbols.

A join by date would shuffle a row for each pair and date. Here each symbol's history is one row, a cluster's symbols are cut into
blocks, each block is stored once, and every two blocks meet in one task, which reads them from there: what is shuffled and stored are
the histories, however many tiles there are, and a pair is a row only when it is a result. Sums over common dates are products of
matrices, symbols by dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import store

#: Symbols of a block. A tile holds two blocks: with ten years of days, about 20 MB for each matrix.
BLOCK = 1024
#: A spread below this share of the squares it was taken from is computed again from the pair's own rows.
THIN = 1e-4
#: Partitions of tiles at most.
MANY = 4096


def tiles(rows: DataFrame, cluster: str, value: str, size: int = BLOCK) -> DataFrame:
    """(symbol, date, cluster, value) -> one row a tile, in partitions of a few: cluster, i <= j, and where blocks i and j are stored.

    The histories are stored as they come, then, with the places that their symbols take in their cluster, by block."""
    spark = rows.sparkSession
    known = rows.where(F.col("date").isNotNull() & F.col("symbol").isNotNull() & F.col(cluster).isNotNull() & F.col(value).isNotNull())
    series = known.groupBy(F.col(cluster).alias("cluster"), "symbol").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("date").alias("d"), F.col(value).cast("double").alias("v")))).alias("s"))
    path, folder = store.scratch(spark, "histories"), store.scratch(spark, "blocks")
    series.select("cluster", "symbol", F.col("s.d").alias("days"), F.col("s.v").alias("values")).write.option("compression", "zstd").parquet(path)
    series = spark.read.parquet(path)
    # One row a symbol, so that a cluster's window is as long as its list of symbols.
    places = series.select("cluster", "symbol").withColumn("block", F.floor((F.row_number().over(Window.partitionBy("cluster").orderBy("symbol")) - 1) / size).cast("int"))
    name = lambda block: F.concat_ws("-", F.md5(F.col("cluster").cast("string").cast("binary")), block)
    placed = series.join(places, ["cluster", "symbol"]).select("symbol", "days", "values", name("block").alias("name"))
    placed.repartition("name").write.option("compression", "zstd").partitionBy("name").parquet(folder)
    last = places.groupBy("cluster").agg(F.max("block").alias("last"))
    of = last.select("cluster", "last", F.explode(F.sequence(F.lit(0), "last")).alias("i")).select("cluster", "i", F.explode(F.sequence("i", "last")).alias("j"))
    part = lambda block: F.concat(F.lit(f"{folder}/name="), name(block))
    n = last.agg(F.sum((F.col("last") + 1) * (F.col("last") + 2) / 2)).first()[0] or 1
    return of.select("cluster", "i", "j", part("i").alias("left"), part("j").alias("right")).repartition(min(int(n), MANY), "cluster", "i", "j")


def opened(tile: pa.Table) -> pa.Table:
    """The histories of both blocks of a tile, read in its task: i, j, block, symbol, days, values."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    row, parts = tile.slice(0, 1).to_pylist()[0], []
    for block, uri in {row["i"]: row["left"], row["j"]: row["right"]}.items():
        where, path = fs.FileSystem.from_uri(uri)
        part = pq.read_table(path, filesystem=where, columns=["symbol", "days", "values"], partitioning=None)
        parts.append(part.append_column("block", pa.array(np.full(len(part), block))))
    out = pa.concat_tables(parts)
    return out.append_column("i", pa.array(np.full(len(out), row["i"]))).append_column("j", pa.array(np.full(len(out), row["j"])))


def grid(group: pa.Table) -> tuple[np.ndarray, list[tuple]]:
    """The days of a tile, and its two sides as (symbols, values, known) with one column for each day: absent values are 0."""
    group = group.combine_chunks()
    block, symbol = group["block"].to_numpy(), group["symbol"].to_numpy()
    days, values = (group[c].combine_chunks() for c in ("days", "values"))
    lengths = np.diff(days.offsets.to_numpy())
    axis, at = np.unique(days.flatten().to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(symbol)), lengths)
    x, known = np.zeros((len(symbol), len(axis))), np.zeros((len(symbol), len(axis)))
    x[row, at], known[row, at] = values.flatten().to_numpy(zero_copy_only=False), 1.0
    sides = []
    for side in (group["i"][0].as_py(), group["j"][0].as_py()):
        mine = np.flatnonzero(block == side)
        mine = mine[np.argsort(symbol[mine], kind="stable")]
        sides.append((symbol[mine], x[mine], known[mine]))
    return axis, sides


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """n, means, and squares and products about the means, of one pair's rows; exactly 0 for a constant."""
    with np.errstate(all="ignore"):
        a, b = x - x[0], y - y[0]
        mean_a, mean_b = a.mean(), b.mean()
        a, b = a - mean_a, b - mean_b
        return x[0] + mean_a, y[0] + mean_b, a @ a, b @ b, a @ b


def _statistics(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(tile: pa.Table) -> pa.Table:
        group = opened(tile)
        _, ((sa, x, ka), (sb, y, kb)) = grid(group)
        if len(x) and len(y):
            odd_x, odd_y = ~np.isfinite(x).all(1), ~np.isfinite(y).all(1)
            raw_x, raw_y = x, y
            with np.errstate(all="ignore"):
                # About a symbol's own mean, so that squares keep their digits.
                cx, cy = (np.where(odd, 0.0, v.sum(1) / k.sum(1)) for odd, v, k in ((odd_x, x, ka), (odd_y, y, kb)))
                x, y = (np.where(odd[:, None], 0.0, (v - c[:, None]) * k) for odd, v, k, c in ((odd_x, x, ka, cx), (odd_y, y, kb, cy)))
                n = ka @ kb.T
                keep = n >= least
                if group["i"][0].as_py() == group["j"][0].as_py():
                    keep &= sa[:, None] < sb[None, :]
                at = np.nonzero(keep)
                n = n[at]
                mx, my, rxx, ryy, sxy = ((p @ q.T)[at] for p, q in ((x, kb), (ka, y), (x * x, kb), (ka, y * y), (x, y)))
                mx, my = mx / n, my / n
                sxx, syy, sxy = rxx - n * mx * mx, ryy - n * my * my, sxy - n * mx * my
                thin = (sxx <= THIN * rxx) | (syy <= THIN * ryy) | odd_x[at[0]] | odd_y[at[1]]
                mx, my = mx + cx[at[0]], my + cy[at[1]]
            for p in np.flatnonzero(thin):
                a, b = at[0][p], at[1][p]
                both = (ka[a] > 0) & (kb[b] > 0)
                mx[p], my[p], sxx[p], syy[p], sxy[p] = _moments(raw_x[a][both], raw_y[b][both])
        else:
            at, n = (np.zeros(0, int),) * 2, np.zeros(0)
            mx = my = sxx = syy = sxy = n
        columns = {"a": sa[at[0]], "b": sb[at[1]], "n": n.astype("int64"), "mean_x": mx, "mean_y": my, "sxx": sxx, "syy": syy, "sxy": sxy}
        return pa.table(columns)

    return run


def _runs(group: pa.Table) -> Iterator[tuple]:
    """For each symbol of a tile's first side: it, the second side's symbols after it, and all rows that they have in common, by symbol and
    day: the number of the second, whether the row before is the same pair's, and both values."""
    _, ((sa, x, ka), (sb, y, kb)) = grid(group)
    inner = group["i"][0].as_py() == group["j"][0].as_py()
    for at, symbol in enumerate(sa):
        days = np.flatnonzero(ka[at])
        first = at + 1 if inner else 0
        place, day = np.nonzero(kb[first:, days])
        yield symbol, sb[first:], place, np.diff(place, prepend=-1) == 0, x[at, days[day]], y[first + place, days[day]]


def _concordance(tile: pa.Table) -> pa.Table:
    found = []
    for symbol, others, place, follows, x, y in _runs(opened(tile)):
        with np.errstate(all="ignore"):
            s = (np.sign(np.diff(x)) * np.sign(np.diff(y)))[follows[1:]]
        at = place[1:][follows[1:]]
        n = np.bincount(at, minlength=len(others))
        some = np.flatnonzero(n)
        found.append((np.full(len(some), symbol), others[some], n[some], np.bincount(at, s, len(others))[some]))
    a, b, n, s = (np.concatenate([f[k] for f in found]) for k in range(4))
    return pa.table({"a": a, "b": b, "n": n.astype("int64"), "s": s.astype(float)})


def concordance(rows: DataFrame, cluster: str, value: str, size: int = BLOCK) -> DataFrame:
    """a < b of a cluster with two common dates: n, moves from one common date to the next, and tau, the mean of the products of their signs."""
    kind = rows.schema["symbol"].dataType.simpleString()
    found = tiles(rows, cluster, value, size).groupBy("cluster", "i", "j").applyInArrow(_concordance, f"a {kind}, b {kind}, n long, s double")
    return found.select("a", "b", "n", (F.col("s") / F.col("n")).alias("tau"))


def statistics(rows: DataFrame, cluster: str, value: str, least: int = 1, size: int = BLOCK) -> DataFrame:
    """a < b of a cluster with at least ``least`` common dates: n, hedge and intercept of b's values on a's, correlation (null without
    spread), the sample deviation of b's values, and that of the residual."""
    kind = rows.schema["symbol"].dataType.simpleString()
    found = tiles(rows, cluster, value, size).groupBy("cluster", "i", "j").applyInArrow(_statistics(least), f"a {kind}, b {kind}, n long, mean_x double, mean_y double, sxx double, syy double, sxy double")
    slope = F.try_divide("sxy", "sxx")
    several = F.when(F.col("n") > 1, F.col("n") - 1)
    spread = F.sqrt(F.col("sxx") / several) * F.sqrt(F.col("syy") / several)
    out = found.select("a", "b", "n", slope.alias("hedge"), (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"), F.try_divide(F.col("sxy") / several, spread).alias("correlation"), F.sqrt(F.col("syy") / several).alias("deviation"))
    return out.withColumn("residual_std", F.col("deviation") * F.sqrt(F.greatest(1 - F.col("correlation") * F.col("correlation"), F.lit(0.0))))
