"""States of a panel by a Gaussian mixture, named by what returns do in them; macro series carried onto bars; filings in XML.

The mixture is fitted by expectation and maximisation: in a round every task turns its rows into each state's share, sums and
products; only those, a few numbers for each state, reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as ar
from ..functions import frames as fr
from ..sources import store

#: Added to variances of standardised features; gain in log likelihood a row at which the fit ends, and its rounds at most.
RIDGE, SETTLED, ROUNDS = 1e-6, 1e-6, 200
#: Rows of a stored block, and rows whose terms are in memory at once.
BLOCK, STEP = 16_384, 4_096


def features(bars: DataFrame) -> DataFrame:
    """Volatility, momentum over 20 and 60 rows, and drawdown from the last 252 rows' high of each symbol: a step over its rows."""

    def step(series: dict[str, np.ndarray]) -> None:
        close = series["close"]
        series.update({name: ar.div(close, ar.lag(close, n)) - 1 for name, n in (("ret", 1), ("momentum_20", 20), ("momentum_60", 60))})
        series["volatility"], series["drawdown"] = ar.std(series["ret"], 20), ar.div(close, ar.largest(close, 252)) - 1

    return ar.along(bars, ["close"], ["ret", "volatility", "momentum_20", "momentum_60", "drawdown"], step)


def _terms(x: np.ndarray) -> np.ndarray:
    """1, each value, and each product of two values of every row; a term's values are next to each other in memory."""
    x, pairs = x.T, list(combinations_with_replacement(range(x.shape[1]), 2))
    out = np.ones((1 + len(x) + len(pairs), x.shape[1]))
    out[1 : 1 + len(x)] = x
    for k, (a, b) in enumerate(pairs, 1 + len(x)):
        np.multiply(x[a], x[b], out=out[k])
    return out.T


def _log_density(weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """What the terms of a row are multiplied by for log(weight times density) of each state: (terms, states)."""
    d, out = mean.shape[1], []
    for w, m, c in zip(weight, mean, cov):
        root = np.linalg.cholesky(c)
        inverse = np.linalg.inv(c)
        square = [-inverse[a, b] * (0.5 if a == b else 1.0) for a, b in combinations_with_replacement(range(d), 2)]
        out.append([np.log(max(w, 1e-300)) - 0.5 * m @ inverse @ m - np.log(np.diag(root)).sum() - 0.5 * d * np.log(2 * np.pi), *(inverse @ m), *square])
    return np.array(out).T


def _quantiles(stored: DataFrame, columns: int, n: int, shares: list[float]) -> list[float]:
    """Exact quantiles of the first column of stored blocks, between the two values next to each. The bits of a double, as a whole number
    in the order of the doubles, are found 16 at a time from counts, so that no values are gathered."""
    places = [q * (n - 1) for q in shares]
    ranks = sorted({int(f(p)) for p in places for f in (np.floor, np.ceil)})
    prefix, below = dict.fromkeys(ranks, 0), dict.fromkeys(ranks, 0)
    for shift in (48, 32, 16, 0):
        wanted = sorted(set(prefix.values()))

        def count(batches: Iterator[pa.RecordBatch], shift=shift, wanted=wanted) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(wanted), 1 << 16), np.int64)
            for batch in batches:
                for block in batch.column(0):
                    bits = np.frombuffer(block.as_buffer()).reshape(columns, -1)[0].view(np.uint64)
                    key = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
                    first, digit = key >> np.uint64(shift) >> np.uint64(16), (key >> np.uint64(shift)) & np.uint64(0xFFFF)
                    for k, start in enumerate(wanted):
                        total[k] += np.bincount((digit if shift == 48 else digit[first == np.uint64(start)]).astype(np.int64), minlength=1 << 16)
            k, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(total[k, digit])], ["k", "digit", "n"])

        found = stored.mapInArrow(count, "k int, digit int, n long").groupBy("k", "digit").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((len(wanted), 1 << 16), np.int64)
        counts[found["k"].to_numpy(), found["digit"].to_numpy()] = found["n"].to_numpy()
        for r in ranks:
            so_far = np.cumsum(counts[wanted.index(prefix[r])])
            digit = int(np.searchsorted(so_far, r - below[r], side="right"))
            prefix[r], below[r] = prefix[r] << 16 | digit, below[r] + (int(so_far[digit - 1]) if digit else 0)
    value = {r: float(np.array(k ^ (1 << 63) if k >> 63 else k ^ ((1 << 64) - 1), np.uint64).view(np.float64)) for r, k in prefix.items()}
    low, high = ([value[int(f(p))] for p in places] for f in (np.floor, np.ceil))
    return [a if a == b else (np.ceil(p) - p) * a + (p - np.floor(p)) * b for p, a, b in zip(places, low, high)]


def mixture(rows: DataFrame, columns: list[str], states: int = 4) -> DataFrame:
    """The rows without nulls in ``columns``, with ``state`` 0 .. states - 1: the likeliest component of a Gaussian mixture of the
    standardised columns. Components start from the rows between equal quantiles of the first column; they are numbered by the mean
    of that column. Without spread or rows every row is in state 0.

    The standardised columns are stored once more as blocks of rows, which a round reads as matrices, column by column."""
    spark = rows.sparkSession
    path = store.scratch(spark, "mixture")
    rows.where(" and ".join(f"{c} is not null" for c in columns)).write.parquet(path)
    rows = spark.read.parquet(path)
    scale = rows.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)), F.count("*").alias("n")).first()
    centre, width = ([scale[f"{p}{k}"] for k in range(len(columns))] for p in "ms")
    if not all(w and w > 1e-12 for w in width):
        return rows.withColumn("state", F.lit(0))
    d = len(columns)
    pairs = list(combinations_with_replacement(range(d), 2))
    names = ["n", *(f"s{k}" for k in range(d)), *(f"p{a}_{b}" for a, b in pairs), "l"]
    fitted = None

    def matrix(values: list[pa.Array]) -> np.ndarray:
        return np.column_stack([(v.to_numpy(zero_copy_only=False) - m) / w for v, m, w in zip(values, centre, width)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stored(parts: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).T.tobytes()], pa.binary())], ["x"])

        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts, held = [*parts, matrix(batch.columns)], held + batch.num_rows
            if held >= BLOCK:
                yield stored(parts)
                parts, held = [], 0
        if parts:
            yield stored(parts)

    path = store.scratch(spark, "mixture-blocks")
    rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(blocks, "x binary").write.option("compression", "none").parquet(path)
    stored = spark.read.parquet(path)
    cuts = np.array(_quantiles(stored, d, scale["n"], [k / states for k in range(1, states)]))
    before = None
    for _ in range(ROUNDS):
        factors = None if fitted is None else _log_density(*fitted)

        def sums(batches: Iterator[pa.RecordBatch], factors=factors) -> Iterator[pa.RecordBatch]:
            total = np.zeros((states, len(names)))
            for batch in batches:
                for block in batch.column(0):
                    whole = np.frombuffer(block.as_buffer()).reshape(d, -1)
                    for at in range(0, whole.shape[1], STEP):
                        x = whole[:, at : at + STEP].T
                        terms = _terms(x).T
                        if factors is None:
                            part = np.eye(states)[:, np.searchsorted(cuts, x[:, 0], side="right")]
                        else:
                            part = factors.T @ terms
                            top = part.max(0)
                            np.exp(np.subtract(part, top, out=part), out=part)
                            every = part.sum(0)
                            part /= every
                            total[:, -1] += top.sum() + np.log(every).sum()
                        total[:, :-1] += part @ terms.T
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(states)), *(pa.array(total[:, c]) for c in range(len(names)))], names=["state", *names])

        found = stored.mapInArrow(sums, "state long, " + ", ".join(f"{c} double" for c in names)).collect()  # one row a task and state
        table = np.array([[r[c] for c in names] for r in found]).reshape(-1, states, len(names)).sum(0)
        n = np.maximum(table[:, :1], 1e-12)
        mean, cov = table[:, 1 : d + 1] / n, np.empty((states, d, d))
        for at, (a, b) in enumerate(pairs):
            cov[:, a, b] = cov[:, b, a] = table[:, d + 1 + at] / n[:, 0] - mean[:, a] * mean[:, b] + (RIDGE if a == b else 0)
        # components that lost their rows are as wide as all data
        cov = np.where((table[:, 0] > d + 1)[:, None, None], cov, np.eye(d))
        fitted = (table[:, 0] / table[:, 0].sum(), mean, cov)
        likelihood = table[0, -1] / table[:, 0].sum()
        if before is not None and abs(likelihood - before) < SETTLED:
            break
        before = likelihood if likelihood else None
    rank, factors = np.argsort(np.argsort(fitted[1][:, 0], kind="stable"), kind="stable").astype(np.int32), _log_density(*fitted)

    @F.arrow_udf("int")
    def state(*values: pa.Array) -> pa.Array:
        return pa.array(rank[(_terms(matrix(values)) @ factors).argmax(1)])

    return rows.withColumn("state", state(*(F.col(c).cast("double") for c in columns)))


def labelled(rows: DataFrame, ret: str = "ret", least: int = 10) -> DataFrame:
    """(symbol, date, state, ret) -> state, n, mean_next, std_next, regime: what the next row's return is after each state.

    With four or more states of at least ``least`` rows, the one with the highest mean is bull, with the lowest crisis; of the
    others the calmest is sideways, the next bear. With two or three the highest is bull, the lowest bear. Others have none."""
    after = rows.withColumn("_next", fr.lead(ret)).groupBy("state").agg(F.count("_next").alias("n"), F.avg("_next").alias("mean_next"), F.stddev_pop("_next").alias("std_next")).where(F.col("n") >= least)
    whole = Window.partitionBy()  # one row a state
    out = after.withColumn("_k", F.count("*").over(whole)).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("mean_next"), "std_next")))
    middle = (F.col("_r") > 1) & (F.col("_r") < F.col("_k"))
    out = out.withColumn("_m", F.row_number().over(Window.partitionBy(middle).orderBy("std_next", "state")))
    many = F.when(F.col("_r") == 1, "bull").when(F.col("_r") == F.col("_k"), "crisis").when(F.col("_m") == 1, "sideways").when(F.col("_m") == 2, "bear")
    few = F.when(F.col("_r") == 1, "bull").when(F.col("_r") == F.col("_k"), "bear")
    return out.select("state", "n", "mean_next", "std_next", F.when(F.col("_k") >= 4, many).when(F.col("_k") >= 2, few).alias("regime"))


def moves(rows: DataFrame, states: int) -> DataFrame:
    """Row-normalised counts of moves between states of consecutive rows of a symbol, all pairs of states."""
    pairs = rows.withColumn("_from", fr.lag("state")).where("_from is not null").groupBy(F.col("_from").alias("before"), F.col("state").alias("after")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(states * states).select((F.col("id") / states).cast("int").alias("before"), (F.col("id") % states).cast("int").alias("after"))
    out = grid.join(F.broadcast(pairs), ["before", "after"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.coalesce(fr.div("n", F.sum("n").over(Window.partitionBy("before"))), F.lit(0.0)))


def with_macro(rows: DataFrame, releases: DataFrame) -> DataFrame:
    """Add level and change of the last release (date, level) on or before each row's date, and how many days old it is.

    Releases are carried over the calendar first, one row a date; then each row takes its date's."""
    ahead = releases.withColumn("change", fr.div("level", F.lag("level").over(Window.orderBy("date"))) - 1).withColumn("released", F.col("date"))
    spine = rows.select("date").unionByName(releases.select("date")).distinct().join(ahead, "date", "left")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    spine = spine.select("date", *(F.last(F.when(F.col("released").isNotNull(), F.struct("level", "change", "released")), True).over(w)[c].alias(f"macro_{c}") for c in ("level", "change", "released")))
    return rows.join(spine, "date", "left").withColumn("macro_age", F.datediff("date", "macro_released")).drop("macro_released")


# -- filings ----------------------------------------------------------------------------------------------------

_value = "struct<value:string>"
FILING = (
    "reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>>, nonDerivativeTable struct<nonDerivativeTransaction:array<struct<"
    f"transactionCoding:struct<transactionCode:string>, transactionAmounts:struct<transactionShares:{_value}, transactionPricePerShare:{_value}>>>>, _corrupt_record string"
)
#: Codes of purchases, awards and exercises.
BUYS = ["P", "A", "M"]


def filings(rows: DataFrame) -> DataFrame:
    """(id, filed, xml) -> one row for each transaction of an ownership report: id, filed, owner, kind, shares, price, value; and one
    row with ``malformed`` true for each document that is no XML. Missing amounts are 0, a missing owner Unknown; a report
    without transactions has no row. Documents are parsed by the reader that Spark has for XML, each in its row."""
    parsed = F.from_xml(F.col("xml"), FILING, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = rows.withColumn("_f", parsed)
    bad = F.col("_f").isNull() | F.col("_f._corrupt_record").isNotNull()
    each = F.when(bad, F.array(F.lit(None).cast("struct<transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:struct<value:string>,transactionPricePerShare:struct<value:string>>>"))).otherwise(F.col("_f.nonDerivativeTable.nonDerivativeTransaction"))
    out = out.select("id", "filed", bad.alias("malformed"), F.col("_f.reportingOwner.reportingOwnerId.rptOwnerName").alias("_owner"), F.explode(each).alias("_t"))
    number = lambda c: F.coalesce(F.expr(f"try_cast({c}.value as double)"), F.lit(0.0))
    shares, price = number("_t.transactionAmounts.transactionShares"), number("_t.transactionAmounts.transactionPricePerShare")
    kind = F.when(F.col("_t.transactionCoding.transactionCode").isin(BUYS), "buy").otherwise("sell")
    good = ~F.col("malformed")
    return out.select("id", "filed", "malformed", F.when(good, F.coalesce("_owner", F.lit("Unknown"))).alias("owner"), F.when(good, kind).alias("kind"), F.when(good, shares).alias("shares"), F.when(good, price).alias("price"), F.when(good, shares * price).alias("value"))
