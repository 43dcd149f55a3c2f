"""Further features: interactions, pair correlations, consensus spreads, path moments, option and social signals, drift after events."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as ar
from ..functions import frames as fr
from . import micro, pairs


def interactions(bars: DataFrame) -> DataFrame:
    """Products of momentum, volatility, volume surprise and range."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_m", fr.change("close", 10)).withColumn("_v", fr.rolling("std", "ret", 10)).withColumn("_q", fr.div("volume", fr.rolling("mean", "volume", 10)) - 1).withColumn("_r", fr.div(F.col("high") - F.col("low"), "close"))
    return out.select("symbol", "date", (F.col("_m") * F.col("_v")).alias("momentum_x_vol"), (F.col("_m") * F.col("_q")).alias("momentum_x_volume"), (F.col("_v") * F.col("_r")).alias("vol_x_range"), (F.col("ret") * F.col("_q")).alias("ret_x_volume"))


_INPUTS = ["ret", "rsi", "adx", "bb_position", "momentum", "volatility", "volume_ratio", "drawdown", "regime_volatility", "sma_cross", "trend", "meanrev"]


def _oscillators(x: dict[str, np.ndarray], n: int = 14) -> None:
    """As ``technical.rsi``, ``adx`` and the position of ``bollinger``."""
    high, low, close = x["high"], x["low"], x["close"]
    before, up, down = ar.lag(close), ar.known(high - ar.lag(high)), ar.known(ar.lag(low) - low)
    d = ar.known(close - before)
    x["rsi"] = 100 - 100 / (1 + ar.known(ar.div(ar.ema(np.maximum(d, 0.0), n), ar.ema(np.maximum(-d, 0.0), n))))
    ranges = ar.ema(np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before))), n)
    plus = ar.known(100 * ar.div(ar.ema(np.where((up > down) & (up > 0), up, 0.0), n), ranges))
    minus = ar.known(100 * ar.div(ar.ema(np.where((down > up) & (down > 0), down, 0.0), n), ranges))
    x["adx"] = ar.ema(ar.known(100 * ar.div(np.abs(plus - minus), plus + minus)), n)
    lower, upper = x["mean_20"] - 2.0 * x["std_20"], x["mean_20"] + 2.0 * x["std_20"]
    x["bb_position"] = ar.div(close - lower, upper - lower)


def _moves(x: dict[str, np.ndarray]) -> None:
    close = x["close"]
    x["mean_20"], x["std_20"] = ar.mean(close, 20), ar.std(close, 20)
    ret = x["ret"] = ar.div(close, ar.lag(close)) - 1
    x["momentum"], x["volatility"], x["regime_volatility"] = ar.div(close, ar.lag(close, 63)) - 1, ar.std(ret, 21), ar.std(ret, 20) * np.sqrt(252.0)
    x["volume_ratio"], x["drawdown"] = ar.div(x["volume"], ar.mean(x["volume"], 20)), ar.div(close, ar.largest(close, 252)) - 1
    middle, z = ar.mean(close, 50), ar.div(close - x["mean_20"], x["std_20"])
    x["sma_cross"], x["trend"] = ar.div(middle, ar.mean(close, 200)) - 1, np.sign(ar.div(x["mean_20"], middle) - 1)
    x["meanrev"] = np.where(z > 2, -1.0, np.where(z < -2, 1.0, 0.0))


def interaction_inputs(bars: DataFrame) -> DataFrame:
    """symbol, date and what ``all_interactions`` multiplies, but the tone: one step over a symbol's bars without nulls."""
    bars = bars.select("symbol", "date", "high", "low", "close", "volume")
    return ar.along(bars, ["high", "low", "close", "volume"], _INPUTS, _moves, _oscillators).select("symbol", "date", *_INPUTS)


def all_interactions(rows: DataFrame) -> DataFrame:
    """The twelve products of tone, momentum, volatility, oscillators, volume, drawdown and signals, of rows that have them as columns.

    rsi counts from its middle and is scaled to -1..1, adx to 0..1, the band position from its middle, the volume ratio from 1."""
    rsi, adx, band, volume = (F.col("rsi") - 50) / 50, F.col("adx") / 100, F.col("bb_position") - 0.5, F.col("volume_ratio") - 1
    tone, mom, vol = F.col("tone"), F.col("momentum"), F.col("volatility")
    products = {
        "tone_x_momentum": tone * mom, "tone_x_volatility": tone * vol, "tone_x_rsi": tone * rsi, "tone_x_volume": tone * volume, "momentum_x_volatility": mom * vol, "rsi_x_adx": rsi * adx,
        "bb_position_x_volume": band * volume, "returns_x_volume": F.col("ret") * volume, "drawdown_x_tone": F.col("drawdown") * tone, "trend_x_meanrev": F.col("trend") * F.col("meanrev"),
        "regime_vol_x_momentum": F.col("regime_volatility") * mom, "sma_cross_x_adx": F.col("sma_cross") * adx,
    }
    return rows.select("symbol", "date", *(c.alias(k) for k, c in products.items()))


def correlation_change(pairs: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    """Correlation of each pair over a short and a long frame, and their difference."""
    w = lambda n: Window.partitionBy("a", "b").orderBy("date").rowsBetween(1 - n, 0)
    c = lambda n: F.when(F.count("x").over(w(n)) >= n, fr.correlation("x", "y", w(n)))
    out = pairs.select("a", "b", "date", c(short).alias("short_corr"), c(long).alias("long_corr"))
    return out.withColumn("change", F.col("short_corr") - F.col("long_corr"))


def trend_regime(bars: DataFrame, n: int = 60) -> DataFrame:
    """volatile above 0.25 of deviation, trending where price and row number correlate above 0.7, else ranging."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_rn", F.row_number().over(fr.series()).cast("double"))
    w = fr.last_rows(n)
    fit = F.when(F.count("close").over(w) >= n, F.abs(fr.correlation("close", "_rn", w)))
    return out.select("symbol", "date", F.when(fr.rolling("std", "ret", n) > 0.25, "volatile").when(fit > 0.7, "trending").otherwise("ranging").alias("regime"))


def _estimators(bars: DataFrame) -> DataFrame:
    """The returns of which Roll's spread is made, and the estimators from highs, lows and closes; that from closes and middles has a value only
    where it is positive."""
    out = micro.close_mid_spread(micro.high_low_spread(bars)).withColumn("_r", fr.change("close"))
    return out.select("symbol", "date", "_r", F.col("high_low_spread").alias("_h"), F.when(F.col("close_mid_spread") > 0, F.col("close_mid_spread")).alias("_m"))


def _spread(x: dict[str, np.ndarray], n: int = 20) -> None:
    """The row's median of the three spread estimators that have a value; Roll's as ``micro.roll_spread``."""
    m, both = ar.products(x["_r"], ar.lag(x["_r"]), n - 1)
    roll = np.where(m >= n - 1, 2 * np.sqrt(np.maximum(-both / (n - 2), 0.0)), np.nan)
    low, mid, high = np.sort(np.stack([roll, x["_h"], x["_m"]]), axis=0)  # nulls last
    x["spread"] = np.where(np.isnan(high), np.where(np.isnan(mid), low, (low + mid) / 2), mid)


def consensus_spread(bars: DataFrame) -> DataFrame:
    """The row's median of the three spread estimators that have a value, and 1 less its rank in the symbol's history.

    The estimator from closes and middles has a value only where it is positive. Spreads that agree to 12 digits tie.
    """
    out = ar.along(_estimators(bars), ["_r", "_h", "_m"], ["spread"], _spread)
    return out.select("symbol", "date", "spread", (1 - fr.pct_rank(F.round("spread", 12), "symbol")).alias("liquidity"))


def illiquidity_signal(bars: DataFrame, n: int = 20, limit: float = 2.0) -> DataFrame:
    """z of the spread over the last 5 n rows with n values at least, 0 without a spread of values; -1 where it is beyond ``limit``."""
    def z(x: dict[str, np.ndarray]) -> None:
        mean, sd = ar.mean(x["spread"], 5 * n, n), ar.std(x["spread"], 5 * n, n)
        x["z"] = np.where(sd > 1e-12, (x["spread"] - mean) / sd, 0.0)

    out = ar.along(_estimators(bars), ["_r", "_h", "_m"], ["z"], _spread, z)
    return out.select("symbol", "date", "z", F.when(F.col("z") > limit, -1).otherwise(0).alias("signal"))


def rough_path(bars: DataFrame, n: int = 20) -> DataFrame:
    """Rolling sums of returns, of products with the lagged volume change, energy, and entropy of absolute returns."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_dv", fr.lag(fr.change("volume"))).withColumn("_a", F.abs("ret"))
    total = fr.rolling("sum", "_a", n)
    logs = fr.rolling("sum", F.when(F.col("_a") > 0, F.col("_a") * F.log("_a")).when(F.col("_a").isNotNull(), 0.0), n)
    return out.select("symbol", "date", fr.rolling("sum", "ret", n).alias("level_1"), fr.rolling("sum", F.col("ret") * F.col("_dv"), n, n - 2).alias("level_2"), fr.rolling("sum", F.col("ret") * F.col("ret"), n).alias("energy"), F.when(total > 0, F.log(total) - logs / total).alias("path_entropy"))


def tail_probabilities(bars: DataFrame, n: int = 60, move: float = 1.5) -> DataFrame:
    """Cornish-Fisher probability of a move beyond ``move`` deviations, and the standardised fifth moment."""
    out = bars.withColumn("ret", fr.change("close"))
    out = out.withColumns({f"_p{k}": F.pow("ret", F.lit(k)) for k in (2, 3, 4, 5)})  # once a row, not once a row and frame
    w = fr.last_rows(n)
    mean, sd = F.avg("ret").over(w), F.stddev_pop("ret").over(w)
    p = {k: F.avg(f"_p{k}").over(w) for k in (2, 3, 4, 5)}
    m3 = p[3] - 3 * mean * p[2] + 2 * F.pow(mean, F.lit(3))
    m5 = p[5] - 5 * mean * p[4] + 10 * mean * mean * p[3] - 10 * F.pow(mean, F.lit(3)) * p[2] + 4 * F.pow(mean, F.lit(5))
    full = F.count("ret").over(w) >= n
    rows = out.select("symbol", "date", F.when(full, fr.div(m3, F.pow(sd, F.lit(3)))).alias("skew"), F.when(full, fr.div(m5, F.pow(sd, F.lit(5)))).alias("fifth"))
    z = move - (move * move - 1) * F.col("skew") / 6
    return rows.select("symbol", "date", "skew", "fifth", (1 - fr.norm_cdf(z)).alias("p_up_tail"))


def options_signal(options: DataFrame, n: int = 10) -> DataFrame:
    """Contrarian on the put-call ratio against its mean, minus the skew's excess (to nine digits, so that rounding decides nothing),
    plus unusual volume; the sign of the sum."""
    mean, skew, sd = fr.rolling("mean", "pc_ratio", n, 3), fr.rolling("mean", "iv_skew", n), fr.rolling("std", "iv_skew", n)
    a = F.when(F.col("pc_ratio") > 1.2 * mean, 1).when(F.col("pc_ratio") < 0.8 * mean, -1).otherwise(0)
    b = F.when(F.round("iv_skew", 9) > F.round(skew + sd, 9), -1).otherwise(0)
    c = F.when(F.col("volume_z") > 2, 1).otherwise(0)
    return options.select("symbol", "date", F.signum((a + b + c).cast("double")).cast("int").alias("signal"))


def social_signal(daily: DataFrame, n: int = 5) -> DataFrame:
    """z of the change of the sentiment and of the volume; contrarian at extremes of both."""
    z = lambda c: fr.div(F.col(c) - fr.rolling("mean", c, n, 3), fr.stepped_std(c, n, 3))
    out = daily.withColumn("_d", F.col("sentiment") - fr.lag("sentiment")).withColumns({"sentiment_z": z("_d"), "volume_z": z("volume")})
    return out.select("symbol", "date", "sentiment_z", "volume_z", F.when((F.col("sentiment_z") > 1) & (F.col("volume_z") > 1), -1).when((F.col("sentiment_z") < -1) & (F.col("volume_z") > 1), 1).otherwise(0).alias("signal"))


def source_blend(parts: dict[str, tuple[DataFrame, float]], calendar: DataFrame) -> DataFrame:
    """Weighted mean of the sources that have a value on a row, weights renormalised."""
    out = calendar.select("symbol", "date")
    for name, (rows, _) in parts.items():
        out = out.join(rows.select("symbol", "date", F.col("value").alias(name)), ["symbol", "date"], "left")
    total = sum((F.when(F.col(n).isNotNull(), w).otherwise(0.0) for n, (_, w) in parts.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, (_, w) in parts.items()), F.lit(0.0))
    return out.select("symbol", "date", fr.div(value, total).alias("blend"))


def drift_window(bars: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """Rows 1 to ``days`` days after an event of their symbol, with the last such event's surprise: a bucketed range join."""
    size = max(days, 1)
    spread = events.select("symbol", F.col("date").alias("_event"), "surprise").withColumn("_bucket", F.explode(F.sequence(F.floor(F.unix_date(F.date_add("_event", 1)) / size), F.floor(F.unix_date(F.date_add("_event", days)) / size))))
    rows = bars.select("symbol", "date").withColumn("_bucket", F.floor(F.unix_date("date") / size))
    near = (F.col("date") > F.col("_event")) & (F.col("date") <= F.date_add("_event", days))
    return rows.join(spread, ["symbol", "_bucket"]).where(near).groupBy("symbol", "date").agg(F.max_by("surprise", "_event").alias("surprise"), F.max("_event").alias("event_date"))


def histogram_entropy(bars: DataFrame, n: int = 30, bins: int = 6) -> DataFrame:
    """Entropy in bits of the last n returns over equal-width bins between their extremes."""
    rows = bars.withColumn("ret", fr.change("close")).withColumn("_x", F.collect_list("ret").over(fr.last_rows(n))).where(F.size("_x") == n).withColumn("_lo", F.array_min("_x")).withColumn("_hi", F.array_max("_x"))
    place = lambda v: F.least(F.floor((v - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    binned = rows.withColumn("_b", F.transform("_x", place))
    share = lambda k: F.size(F.filter("_b", lambda b: b == k)) / float(n)
    entropy = sum((F.when(share(k) > 0, -share(k) * F.log2(share(k))).otherwise(0.0) for k in range(bins)), F.lit(0.0))
    return binned.select("symbol", "date", F.when(F.col("_hi") > F.col("_lo"), entropy).otherwise(0.0).alias("entropy"))


def variance_time_hurst(bars: DataFrame, scales: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """H = 1 + slope / 2 of the log variance of block means on the log block length."""
    rows = bars.withColumn("ret", fr.change("close")).where("ret is not null").withColumn("_rn", F.row_number().over(fr.series()) - 1).withColumn("m", F.explode(F.array(*map(F.lit, scales))))
    blocks = rows.groupBy("symbol", "m", F.floor(F.col("_rn") / F.col("m")).alias("_k")).agg(F.avg("ret").alias("_b"), F.count("*").alias("_n")).where("_n = m")
    variance = blocks.groupBy("symbol", "m").agg(F.var_pop("_b").alias("_v")).where("_v > 0")
    out = variance.groupBy("symbol").agg(F.count("*").alias("_n"), F.regr_slope(F.log("_v"), F.log(F.col("m").cast("double"))).alias("_s")).where("_n >= 3")
    return out.select("symbol", (1 + F.col("_s") / 2).alias("hurst"))


def tail_dependence(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """Kendall-like concordance of neighbouring rows of each pair of a cluster, and the closed-form tail dependences it implies."""
    out = pairs.concordance(rows, cluster, value)
    theta = 2 * F.col("tau") / (1 - F.col("tau"))
    return out.select("a", "b", "n", "tau", F.when((F.col("tau") > 0.01) & (F.col("tau") < 0.99), F.pow(F.lit(2.0), -1 / theta)).otherwise(0.0).alias("lower_tail"), F.when((F.col("tau") > 0) & (F.col("tau") < 0.99), 2 - F.pow(F.lit(2.0), 1 - F.col("tau"))).otherwise(0.0).alias("upper_tail"))


def residual_targets(rows: DataFrame, cluster: str, horizon: int = 5) -> DataFrame:
    """Forward return less half the market's and half the cluster's."""
    out = rows.withColumn("_f", fr.div(fr.lead("close", horizon), "close") - 1)
    return out.where("_f is not null").select("symbol", "date", (F.col("_f") - 0.5 * F.avg("_f").over(fr.across("date")) - 0.5 * F.avg("_f").over(fr.across("date", cluster))).alias("target"))


