"""Strategy signals, composites, pair positions, walk-forward search, votes and sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr
from .recursions import positions

NAMES = ("reversion", "trend", "breakout", "momentum")


def strategies(bars: DataFrame) -> DataFrame:
    """For each of mean reversion, trend, breakout and time-series momentum a signal (-1, 0, 1) and a confidence in 0..1; a signal
    without enough history is 0."""
    before = fr.series().rowsBetween(-20, -1)
    out = bars.withColumn("_z", fr.zscore("close", 20)).withColumn("_t", fr.div(fr.rolling("mean", "close", 20), fr.rolling("mean", "close", 50)) - 1).withColumn("_m", fr.change("close", 63))
    out = out.withColumns({"_high": F.when(F.count("high").over(before) >= 20, F.max("high").over(before)), "_low": F.when(F.count("low").over(before) >= 20, F.min("low").over(before))})
    sign = lambda c: F.coalesce(F.signum(c), F.lit(0.0)).cast("int")
    sure = lambda c: F.coalesce(F.least(F.abs(c), F.lit(1.0)), F.lit(0.0))
    signal = {
        "reversion": (F.when(F.col("_z") > 2, -1).when(F.col("_z") < -2, 1).otherwise(0), sure(F.col("_z") / 3)), "trend": (sign(F.col("_t")), sure(F.col("_t") * 10)),
        "breakout": (F.when(F.col("close") > F.col("_high"), 1).when(F.col("close") < F.col("_low"), -1).otherwise(0), sure(fr.div("close", (F.col("_high") + F.col("_low")) / 2) - 1)), "momentum": (sign(F.col("_m")), sure(F.col("_m"))),
    }
    return out.withColumns({f"{n}_{part}": c for n, both in signal.items() for part, c in zip(("signal", "confidence"), both)}).drop("_z", "_t", "_m", "_high", "_low")


def composite(rows: DataFrame, state: DataFrame, weights: dict[str, tuple[float, ...]]) -> DataFrame:
    """The strategies' signals times confidences, weighted by the symbol's regime (its row of ``state``)."""
    met = rows.join(state, "symbol")
    total = F.lit(0.0)
    for k, name in enumerate(NAMES):
        weight = F.lit(0.0)
        for regime, own in weights.items():
            weight = F.when(F.col("regime") == regime, own[k]).otherwise(weight)
        total = total + weight * F.col(f"{name}_signal") * F.col(f"{name}_confidence")
    return met.select("symbol", "date", "regime", total.alias("composite"))


def last_regime(rows: DataFrame, n: int = 30) -> DataFrame:
    """The regime of each symbol from its last n rows: trending if the mean ADX is over 25, else reverting if the variance of
    5-row returns is below 5 times that of single rows, else mixed."""
    late = rows.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_k") <= n)
    out = late.groupBy("symbol").agg(F.avg("adx").alias("_adx"), fr.div(F.var_samp("ret_5"), 5 * F.var_samp("ret")).alias("_ratio"))
    return out.select("symbol", F.when(F.col("_adx") > 25, "trending").when(F.col("_ratio") < 1, "reverting").otherwise("mixed").alias("regime"))


def adaptive(rows: DataFrame) -> DataFrame:
    """Weights by four regimes, from volatility (20 over 63 rows) and trend (20 over 50); a composite against the trend counts a quarter."""
    out = rows.withColumn("ret", fr.change("close")).withColumn("_v", fr.div(fr.rolling("std", "ret", 20), fr.rolling("std", "ret", 63))).withColumn("_t", fr.div(fr.rolling("mean", "close", 20), fr.rolling("mean", "close", 50)) - 1)
    wild, strong = F.coalesce(F.col("_v") > 1.2, F.lit(False)), F.coalesce(F.abs("_t") > 0.1, F.lit(False))
    regime = F.when(wild & strong, "wild trend").when(wild, "wild range").when(strong, "calm trend").otherwise("calm range")
    table = {"wild trend": (0.1, 0.4, 0.2, 0.3), "wild range": (0.6, 0.1, 0.1, 0.2), "calm trend": (0.1, 0.5, 0.1, 0.3), "calm range": (0.5, 0.2, 0.1, 0.2)}
    total = F.lit(0.0)
    for k, name in enumerate(NAMES):
        weight = F.lit(0.0)
        for state, own in table.items():
            weight = F.when(regime == state, own[k]).otherwise(weight)
        total = total + weight * F.col(f"{name}_signal") * F.col(f"{name}_confidence")
    damped = F.when(total * F.coalesce(F.col("_t"), F.lit(0.0)) < 0, 0.25 * total).otherwise(total)
    return out.select("symbol", "date", regime.alias("regime"), damped.alias("composite"))


def enhanced(base: DataFrame, extra: DataFrame) -> DataFrame:
    """60 % of the composite and 40 % of another score (symbol, date, score); a fifth more where their signs agree, within -1..1."""
    met = base.join(extra, ["symbol", "date"], "left")
    score = F.coalesce(F.col("score"), F.lit(0.0))
    mixed = 0.6 * F.col("composite") + 0.4 * score
    boosted = F.when(F.signum("composite") * F.signum(score) > 0, 1.2 * mixed).otherwise(mixed)
    return met.select("symbol", "date", fr.clip(boosted, -1.0, 1.0).alias("signal"))


def pair_positions(z: DataFrame, enter: float = 2.0, leave: float = 0.5) -> DataFrame:
    """(a, b, date, z) -> position of each pair: -1 above ``enter``, 1 below its negative, 0 again within ``leave``."""
    return positions(z.select("a", "b", "date", "z"), "z", enter, leave, ["a", "b"]).select("a", "b", "date", "position")


def pair_returns(positions: DataFrame, moves: DataFrame) -> DataFrame:
    """(a, b, date, spread_return) and positions -> per date the mean over pairs of yesterday's position times today's move."""
    held = positions.withColumn("_held", F.lag("position").over(Window.partitionBy("a", "b").orderBy("date")))
    met = held.where("_held <> 0").join(moves, ["a", "b", "date"])
    return met.groupBy("date").agg(F.avg(F.col("_held") * F.col("spread_return")).alias("ret"), F.count("*").alias("n"))


def confirmation(pairs: DataFrame, features: DataFrame, column: str) -> DataFrame:
    """(a, b, date) -> the mean of both symbols' latest feature, carried forward."""
    x, y = (features.select(F.col("symbol").alias(k), "date", F.col(column).alias(f"_{k}")) for k in ("a", "b"))
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    met = pairs.join(x, ["a", "date"], "left").join(y, ["b", "date"], "left")
    return met.select("a", "b", "date", ((F.last("_a", True).over(w) + F.last("_b", True).over(w)) / 2).alias("confirmation"))


def folds(dates: DataFrame, train: int, test: int, expanding: bool) -> DataFrame:
    """date, fold, part: a date of the calendar may be in several folds; a fold's test follows its train."""
    out = dates.select("date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("date")) - 1)
    last = out.agg(F.count("*").alias("_n"))  # one row
    fold = F.floor((F.col("_n") - train) / test)  # of whole folds
    out = out.join(F.broadcast(last)).where(fold > 0)
    start = F.greatest(F.lit(0), F.floor((F.col("_d") - train) / test)) if expanding else F.greatest(F.lit(0), F.floor((F.col("_d") - train - test) / test) + 1)
    stop = fold - 1 if expanding else F.least(fold - 1, F.floor(F.col("_d") / test))
    placed = out.where(start <= stop).withColumn("fold", F.explode(F.sequence(start, stop)))
    k = F.col("_d") - F.col("fold") * test
    return placed.where((k < train + test) & ((k >= 0) | F.lit(expanding))).select("date", "fold", F.when(k < train, "train").otherwise("test").alias("part"))


def search(daily: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """(k, threshold, date, ret) over folds -> the parameters with the best mean over each fold's train dates, among those with
    ``least`` dates there, and their mean over its test dates."""
    sums = daily.join(F.broadcast(parts), "date").groupBy("fold", "k", "threshold").agg(F.avg(F.when(F.col("part") == "train", F.col("ret"))).alias("train"), F.count_if(F.col("part") == "train").alias("_n"), F.avg(F.when(F.col("part") == "test", F.col("ret"))).alias("test"))
    w = Window.partitionBy("fold").orderBy(F.desc(F.round("train", 9)), "k", "threshold")
    return sums.where(F.col("_n") >= least).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("fold", "k", "threshold", "train", "test")


def stability(best: DataFrame) -> DataFrame:
    """How often each pair of parameters was best, and what it gave on the test dates."""
    return best.groupBy("k", "threshold").agg(F.count("*").alias("n"), F.avg("test").alias("mean_test"), F.stddev_samp("test").alias("std_test"))


def vote(rows: DataFrame, models: dict[str, float]) -> DataFrame:
    """Weighted soft vote, hard vote (share of models over a half) and disagreement of probability columns; nulls leave a model out."""
    parts = [(F.col(c), w) for c, w in models.items()]
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    soft = fr.div(sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0)), weight)
    n = sum((c.isNotNull().cast("double") for c, _ in parts), F.lit(0.0))
    hard = fr.div(sum((F.coalesce((c > 0.5).cast("double"), F.lit(0.0)) for c, _ in parts), F.lit(0.0)), n)
    return rows.withColumns({"soft": soft, "hard": hard, "spread": F.greatest(*(c for c, _ in parts)) - F.least(*(c for c, _ in parts))})


def error_weights(rows: DataFrame, errors: list[str], n: int = 20) -> DataFrame:
    """Weights 1 / (1 + mean error of the n rows before), scaled to one."""
    w = fr.series().rowsBetween(-n, -1)
    raw = {c: 1 / (1 + F.coalesce(F.avg(c).over(w), F.lit(0.0))) for c in errors}
    out = rows.withColumns({f"_{c}": x for c, x in raw.items()})
    total = sum((F.col(f"_{c}") for c in errors), F.lit(0.0))
    return out.withColumns({f"weight_{c}": F.col(f"_{c}") / total for c in errors}).drop(*(f"_{c}" for c in errors))


def targets(rows: DataFrame, score: str, confidence: str, threshold: float, n: int, gross: float = 1.0) -> DataFrame:
    """Target weights of a date: the n largest |score| x confidence over the threshold, in proportion, with the score's sign."""
    out = rows.withColumn("_s", F.col(score) * F.col(confidence)).where(F.abs("_s") > threshold)
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("_s")), "symbol"))).where(F.col("_r") <= n)
    return out.select("symbol", "date", (gross * fr.div("_s", F.sum(F.abs("_s")).over(fr.across("date")))).alias("weight"))


def stepped(x: Column, steps: list[tuple[float, float]], last: float) -> Column:
    """The value of the first step whose bound is above x, else ``last``."""
    out = None
    for bound, value in steps:
        out = F.when(x < bound, value) if out is None else out.when(x < bound, value)
    return out.otherwise(last)


def position_size(win_rate: Column, payoff: Column, vol: Column, drawdown: Column, sign: Column, target: float = 0.15, most: float = 0.25) -> Column:
    """Half Kelly and volatility target in equal parts, by the drawdown's step and the sign, within +-``most``."""
    kelly = F.coalesce(fr.clip(win_rate - fr.div(1 - win_rate, payoff), 0.0, 1.0), F.lit(0.0)) / 2
    blend = 0.5 * kelly + 0.5 * F.least(F.coalesce(fr.div(F.lit(target), vol), F.lit(0.0)), F.lit(1.0))
    return fr.clip(blend * stepped(-drawdown, [(0.05, 1.0), (0.1, 0.75), (0.2, 0.5)], 0.25) * sign, -most, most)
