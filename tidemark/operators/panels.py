"""Stability of residuals, signature slopes, drift adjustments, filing signals, profiles and tables for training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as ar
from ..functions import frames as fr


def with_market_and_peers(rows: DataFrame, cluster: str) -> DataFrame:
    """Add the date's mean return, and the mean return of the other rows of the date's cluster; 0 where there are none."""
    own = fr.across("date", cluster)
    others = fr.div(F.sum("ret").over(own) - F.col("ret"), F.count("ret").over(own) - 1)
    return rows.fillna(0.0, ["ret"]).withColumns({"market": F.avg("ret").over(fr.across("date")), "peers": F.coalesce(others, F.lit(0.0))})


def residual_stability(rows: DataFrame, n: int = 64, least: int = 10) -> DataFrame:
    """Beta of ret on market over the last n rows, and 1 - abs(AR(1)) of ret - peers - beta * market over the same rows.

    The row's beta holds for its whole frame, so residuals differ from row to row; their products with the row before
    expand into rolling sums of products of the columns, and nothing is listed. Both are 0 below ``least`` rows; a frame
    whose residuals vanish has stability 1.
    """
    def step(x: dict[str, np.ndarray]) -> None:
        ret, market = x["ret"], x["market"]
        a = ret - x["peers"]
        b, k = ar.lag(a), ar.lag(market)
        _, both = ar.products(ret, market, n)
        beta = ar.known(ar.div(both, ar.moments(market, n)[2]))
        ab, mb, ak, mk, bb, bk, kk = ar.total(np.stack([a * b, market * b, a * k, market * k, b * b, b * k, k * k]), n - 1)
        product = ab - beta * (mb + ak) + beta * beta * mk
        square = bb - 2 * beta * bk + beta * beta * kk
        steady = np.where(square > 1e-12 * bb, np.maximum(1 - np.abs(ar.div(product, square)), 0.0), 1.0)
        enough = ar.count(ret, n) >= least
        x["beta"], x["stability"] = np.where(enough, beta, 0.0), np.where(enough, steady, 0.0)

    return ar.along(rows.select("symbol", "date", "ret", "market", "peers"), ["ret", "market", "peers"], ["beta", "stability"], step).select("symbol", "date", "beta", "stability")


def signature_slope(bars: DataFrame, n: int = 60, every: int = 5, least: int = 20, steps: tuple[int, ...] = (1, 2, 5, 10, 15), periods: int = 252) -> DataFrame:
    """Slope of the volatility signature on the sampling step, at every fifth row over its last n closes, carried forward.

    A step counts if it leaves two returns; 0 before the first slope. The windows of a symbol are the rows of one matrix.
    """
    def step(x: dict[str, np.ndarray]) -> None:
        close = x["close"]
        due = np.arange(least, len(close) + 1, every) - 1
        windows = np.full((len(due), n), np.nan)
        for row, i in zip(windows, due, strict=True):
            there = close[max(i + 1 - n, 0) : i + 1]
            there = there[~np.isnan(there)]
            row[: len(there)] = there
        there, vol = np.zeros((len(due), len(steps))), np.zeros((len(due), len(steps)))
        for j, s in enumerate(steps):
            ratio = windows[:, s::s] / windows[:, : (n - 1) // s * s : s]
            moves = np.where(ratio > 0, np.log(ratio), np.nan)
            k = (~np.isnan(moves)).sum(1)
            away = ar.known(moves - (ar.known(moves).sum(1) / np.maximum(k, 1))[:, None])
            there[:, j], vol[:, j] = k >= 2, np.where(k >= 2, np.sqrt((away * away).sum(1) / np.maximum(k - 1, 1) * (periods / s)), 0.0)
        at = np.array(steps, float)
        k, sx, sxx, sy, sxy = there.sum(1), there @ at, there @ (at * at), vol.sum(1), vol @ at
        slope = np.full(len(close), np.nan)
        slope[due] = np.where(k >= 2, ar.div(k * sxy - sx * sy, k * sxx - sx * sx), np.nan)
        x["slope"] = ar.carried(slope)

    return ar.along(bars.select("symbol", "date", "close"), ["close"], ["slope"], step).select("symbol", "date", "slope")


def drift_adjusted(rows: DataFrame, least: float = 5.0, days: int = 60, up: float = 1.25, down: float = 0.85) -> DataFrame:
    """Raise or lower ``confidence`` 1 to ``days`` days after a surprise of ``least`` percent or more; clipped to 0 and 1.

    Rows need surprise_pct and days_since; a null leaves the confidence as it is.
    """
    near = F.col("days_since").between(1, days) & (F.abs("surprise_pct") >= least)
    out = rows.withColumnRenamed("confidence", "confidence_raw")
    out = out.withColumn("multiplier", F.when(near & (F.col("surprise_pct") > 0), up).when(near & (F.col("surprise_pct") < 0), down).otherwise(1.0))
    return out.withColumn("confidence", fr.clip(F.col("confidence_raw") * F.col("multiplier"), 0.0, 1.0))


def insider_signal(filings: DataFrame, buy: float = 0.3, sell: float = -0.3) -> DataFrame:
    """Per symbol: counts and values of buys and sells, both sentiments, and the sign of a count sentiment beyond its threshold."""
    is_buy, is_sell = F.col("kind") == "buy", F.col("kind") == "sell"
    out = filings.groupBy("symbol").agg(F.count_if(is_buy).alias("n_buys"), F.count_if(is_sell).alias("n_sells"), F.sum(F.when(is_buy, F.abs("amount")).otherwise(0.0)).alias("_b"), F.sum(F.when(is_sell, F.abs("amount")).otherwise(0.0)).alias("_s"))
    score = (F.col("n_buys") - F.col("n_sells")) / (F.col("n_buys") + F.col("n_sells") + 1)
    value = F.coalesce(fr.div(F.col("_b") - F.col("_s"), F.col("_b") + F.col("_s")), F.lit(0.0))
    return out.select("symbol", F.when(score > buy, 1).when(score < sell, -1).otherwise(0).alias("signal"), score.alias("sentiment_score"), value.alias("value_sentiment"), "n_buys", "n_sells")


def amount_middle(text: str) -> Column:
    """The middle of a range such as $1,001 - $15,000; of one amount, itself; null where no number stands."""
    ends = F.split(F.regexp_replace(text, "[$,]", ""), r"\s*-\s*")
    low, high = (F.trim(F.get(ends, F.lit(k))).try_cast("double") for k in (0, 1))
    return (low + F.coalesce(high, low)) / 2


def congress_signal(trades: DataFrame) -> DataFrame:
    """Per symbol: buys, sells, their balance, its sign, and a confidence that is full at five trades."""
    is_buy, is_sell = F.col("kind") == "buy", F.col("kind") == "sell"
    out = trades.groupBy("symbol").agg(F.count_if(is_buy).alias("n_buys"), F.count_if(is_sell).alias("n_sells"), F.sum("amount").alias("amount"))
    n, net = F.col("n_buys") + F.col("n_sells"), F.col("n_buys") - F.col("n_sells")
    return out.select("symbol", F.signum(net.cast("double")).cast("int").alias("signal"), "n_buys", "n_sells", F.coalesce(fr.div(net, n), F.lit(0.0)).alias("sentiment"), F.least(n / 5.0, F.lit(1.0)).alias("confidence"), "amount")


def calibration(bars: DataFrame, n: int = 120) -> DataFrame:
    """Mean and deviation of returns, ranges over the close and log volumes of a symbol's last n rows, and its last close.

    Where a mean has no value or a deviation is at most 1e-6, fixed values stand in.
    """
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    rows = bars.withColumns({"_back": back, "_ret": fr.change("close")}).where(F.col("_back") <= n)
    rows = rows.withColumns({"_ret": F.when(F.col("_back") < n, F.col("_ret")), "_range": fr.div(F.col("high") - F.col("low"), "close"), "_log": F.when(F.col("volume") > 0, F.log("volume"))})
    out = rows.groupBy("symbol").agg(*(f(c).alias(f"{name}_{k}") for c, name in (("_ret", "return"), ("_range", "range"), ("_log", "volume")) for k, f in (("mean", F.avg), ("std", F.stddev_samp))), F.max_by("close", "date").alias("last_close"))
    # What stands in for the mean and the deviation.
    usual = {"return": (0.0002, 0.012), "range": (0.015, 0.006), "volume": (15.0, 0.5)}
    mean = lambda c: F.coalesce(F.col(f"{c}_mean"), F.lit(usual[c][0])).alias(f"{c}_mean")
    std = lambda c: F.when(F.col(f"{c}_std") > 1e-6, F.col(f"{c}_std")).otherwise(usual[c][1]).alias(f"{c}_std")
    return out.select("symbol", *(f(c) for c in usual for f in (mean, std)), "last_close")


def profile_returns(rows: DataFrame, cost_bps: float) -> DataFrame:
    """Mean return of the symbols by date, less the cost of entry on the first date and of exit on the last, if they differ."""
    daily = rows.groupBy("date").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("_r"))
    ends = daily.agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    held = daily.join(F.broadcast(ends))
    edge = ((F.col("date") == F.col("_first")) | (F.col("date") == F.col("_last"))) & (F.col("_first") < F.col("_last"))
    return held.select("date", (F.col("_r") - F.when(edge, cost_bps / 10000).otherwise(0.0)).alias("profile_return"))


def article_span(articles: DataFrame, start: str, end: str, score: str) -> DataFrame:
    """By symbol: articles of a range of days, those without a score, first and last day."""
    return articles.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col(score).isNull()).alias("n_unscored"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def one_schema(parts: list[DataFrame], aliases: dict[str, list[str]]) -> DataFrame:
    """Stack tables whose columns have different names: each column is the first of its aliases that a row has."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*(F.coalesce(*(F.col(a) for a in names if a in out.columns)).alias(name) for name, names in aliases.items()))


def training_table(rows: DataFrame, features: list[str], horizon: int = 5, buy: float = 0.005, sell: float = -0.005, share: float = 0.8) -> DataFrame:
    """Scaled features with classes of the forward return (0 sell, 1 hold, 2 buy) and a split in time by symbol.

    Rows without a feature or target are left out; the scaler knows the training rows of all symbols only, and a feature
    without spread is only centred.
    """
    out = rows.withColumn("_f", fr.div(fr.lead("close", horizon), "close") - 1).dropna(subset=["_f", *features])
    out = out.withColumns({"_k": F.row_number().over(fr.series()), "_n": F.count("*").over(fr.across("symbol"))})
    out = out.withColumn("part", F.when(F.col("_k") <= F.floor(F.col("_n") * share), "train").otherwise("test"))
    scale = out.where("part = 'train'").agg(*(f(c).alias(f"_{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = [((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) for c in features]
    return out.join(F.broadcast(scale)).select("symbol", "date", "part", F.when(F.col("_f") > buy, 2).when(F.col("_f") < sell, 0).otherwise(1).alias("label"), *scaled)
