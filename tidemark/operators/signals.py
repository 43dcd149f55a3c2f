"""Signals, state machines with hysteresis, pairs, blends and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr
from .recursions import positions


def crossover(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    d = fr.rolling("mean", "close", fast) - fr.rolling("mean", "close", slow)
    return bars.select("symbol", "date", F.coalesce(F.signum(d), F.lit(0.0)).cast("int").alias("signal"))


def channel(bars: DataFrame, n: int = 20, strict: bool = True) -> DataFrame:
    """Beyond the extremes of the n rows before; not strict includes the row itself, so it never fires."""
    w = fr.series().rowsBetween(-n, -1) if strict else fr.last_rows(n)
    high, low, k = F.max("high").over(w), F.min("low").over(w), F.count("high").over(w)
    return bars.select("symbol", "date", F.when((k >= n) & (F.col("close") > high), 1).when((k >= n) & (F.col("close") < low), -1).otherwise(0).alias("signal"))


def hysteresis(rows: DataFrame, score: str, enter: float, leave: float) -> DataFrame:
    """A position per symbol: from 0 to -1 above ``enter``, to 1 below -enter; back to 0 when |score| is below ``leave``."""
    return positions(rows.select("symbol", "date", score), score, enter, leave, ["symbol"]).select("symbol", "date", "position")


def ratings(bars: DataFrame) -> DataFrame:
    """Momentum, mean reversion and trend signals with confidences, blended by confidence, less half their spread."""
    out = bars.withColumn("_m", F.tanh(5 * F.coalesce(fr.change("close", 21), F.lit(0.0)))).withColumn("_z", F.coalesce(-fr.zscore("close", 20) / 3, F.lit(0.0)))
    out = out.withColumn("_t", F.tanh(10 * F.coalesce(fr.div(fr.rolling("mean", "close", 5), fr.rolling("mean", "close", 20)) - 1, F.lit(0.0))))
    parts = ["_m", "_z", "_t"]
    weights = sum((F.abs(c) for c in parts), F.lit(0.0))
    blended = F.coalesce(fr.div(sum((F.col(c) * F.abs(c) for c in parts), F.lit(0.0)), weights), F.lit(0.0))
    mean = sum((F.col(c) for c in parts), F.lit(0.0)) / 3
    spread = F.sqrt(sum(((F.col(c) - mean) * (F.col(c) - mean) for c in parts), F.lit(0.0)) / 3)
    return out.select("symbol", "date", blended.alias("signal"), (1 - spread / 2).alias("agreement"))


def pair_statistics(pairs: DataFrame, least: int = 20) -> DataFrame:
    """Hedge ratio, intercept, correlation and residual deviation of y on x for each pair."""
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("hedge"), F.regr_intercept("y", "x").alias("intercept"), fr.div(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")).alias("correlation"), F.stddev_samp("y").alias("_sy"))
    out = out.where(F.col("n") >= least).withColumn("residual_std", F.col("_sy") * F.sqrt(F.greatest(1 - F.col("correlation") * F.col("correlation"), F.lit(0.0))))
    return out.drop("_sy")


def best_pairs(stats: DataFrame, k: int) -> DataFrame:
    return stats.where("correlation is not null").withColumn("pair_score", F.abs("correlation")).orderBy(F.desc("pair_score"), "a", "b").limit(k)


def spread_z(pairs: DataFrame, stats: DataFrame, n: int = 20) -> DataFrame:
    """Rolling z of each pair's residual, with entry beyond 2."""
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(1 - n, 0)
    rows = pairs.join(stats.select("a", "b", "hedge", "intercept"), ["a", "b"]).withColumn("_e", F.col("y") - F.col("hedge") * F.col("x") - F.col("intercept"))
    z = F.when(F.count("_e").over(w) >= n, fr.div(F.col("_e") - F.avg("_e").over(w), F.stddev_samp("_e").over(w)))
    return rows.withColumn("z", z).select("a", "b", "date", "z", F.when(F.col("z") > 2, -1).when(F.col("z") < -2, 1).otherwise(0).alias("signal"))


def regime(market: DataFrame) -> DataFrame:
    """crisis, bear, bull or sideways by trailing volatility and return of a daily series (one row per date)."""
    w = Window.orderBy("date").rowsBetween(-19, 0)
    out = market.withColumn("_v", F.stddev_samp("market").over(w)).withColumn("_m", F.sum("market").over(w))
    return out.select("date", F.when(F.col("_v") > 0.8, "crisis").when(F.col("_m") < -1, "bear").when(F.col("_m") > 1, "bull").otherwise("sideways").alias("regime"))


def transitions(states: DataFrame) -> DataFrame:
    """Row-normalised transition counts between consecutive states."""
    moves = states.withColumn("before", F.lag("regime").over(Window.orderBy("date"))).where("before is not null")
    out = moves.groupBy("before", "regime").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def blend(rows: DataFrame) -> DataFrame:
    """(symbol, date, name, signal, confidence) -> confidence-weighted signal and whether all signs agree."""
    return rows.groupBy("symbol", "date").agg(F.coalesce(fr.div(F.sum(F.col("signal") * F.col("confidence")), F.sum("confidence")), F.lit(0.0)).alias("signal"), (F.min(F.signum("signal")) == F.max(F.signum("signal"))).alias("agree"))


def threshold_signals(rows: DataFrame, score: str, high: float, low: float) -> DataFrame:
    return rows.withColumn("signal", F.when(F.col(score) >= high, 1).when(F.col(score) <= low, -1).otherwise(0))


def loss_limit(curve: DataFrame, limit: float) -> DataFrame:
    """Stopped from the row on at which a month's loss since its first row reaches the limit, until the month ends."""
    month = F.trunc("date", "month")
    w = Window.partitionBy("symbol", month).orderBy("date")
    out = curve.withColumn("_l", fr.div("growth", F.first("growth").over(w)) - 1)
    return out.select("symbol", "date", F.max((F.col("_l") <= -limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("stopped"))


def drawdown_guard(curve: DataFrame, limit: float) -> DataFrame:
    """Halted from the first row whose drawdown reaches the limit."""
    return curve.select("symbol", "date", F.max((F.col("drawdown") <= -limit).cast("int")).over(fr.so_far()).alias("halted"))
