"""Technical and price features per symbol: windows over rows in date order, recursive averages as closed forms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as ar
from ..functions import frames as fr


def moving(bars: DataFrame, n: int = 20) -> DataFrame:
    """Rolling mean, deviation, minimum and maximum of the close."""
    return bars.select("symbol", "date", *(fr.rolling(k, "close", n).alias(f"{k}_{n}") for k in ("mean", "std", "min", "max")))


def _gains(bars: DataFrame) -> DataFrame:
    d = F.coalesce(F.col("close") - fr.lag("close"), F.lit(0.0))
    return bars.withColumn("_gain", F.greatest(d, F.lit(0.0))).withColumn("_loss", F.greatest(-d, F.lit(0.0)))


def _strength(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rsi", 100 - 100 / (1 + F.coalesce(fr.div("_g", "_l"), F.lit(0.0)))).drop("_gain", "_loss", "_g", "_l")


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """100 - 100 / (1 + mean gain / mean loss), recursive means of span n; a relative strength of 0 where nothing was lost."""
    return _strength(fr.ema(_gains(bars), {"_g": ("_gain", n), "_l": ("_loss", n)}, by="_gain"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    out = fr.ema(bars, {"_f": ("close", fast), "_s": ("close", slow)}, by="close").withColumn("macd", F.col("_f") - F.col("_s"))
    return fr.ema(out, {"macd_signal": ("macd", signal)}).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = fr.rolling("mean", "close", n), fr.rolling("std", "close", n)
    return bars.withColumn("bb_mid", mid).withColumn("_sd", sd).withColumn("bb_upper", F.col("bb_mid") + k * F.col("_sd")).withColumn("bb_lower", F.col("bb_mid") - k * F.col("_sd")).withColumn("bb_position", fr.div(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))).drop("_sd")


def true_range() -> Column:
    """The largest of high - low and both distances from the close before."""
    before = fr.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Recursive mean of the true range; the first row's range is high - low."""
    return fr.ema(bars.withColumn("_tr", true_range()), {"atr": ("_tr", n)}).drop("_tr")


def atr_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    return bars.withColumn("_tr", true_range()).withColumn("atr_simple", fr.rolling("mean", "_tr", n)).drop("_tr")


def stochastic(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    low, high = fr.rolling("min", "low", n), fr.rolling("max", "high", n)
    return bars.withColumn("stoch_k", 100 * fr.div(F.col("close") - low, high - low)).withColumn("stoch_d", fr.rolling("mean", "stoch_k", d))


def _directions(bars: DataFrame) -> DataFrame:
    up = F.coalesce(F.col("high") - fr.lag("high"), F.lit(0.0))
    down = F.coalesce(fr.lag("low") - F.col("low"), F.lit(0.0))
    moves = bars.withColumn("_up", up).withColumn("_down", down)
    return moves.withColumn("_plus", F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)).withColumn("_minus", F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0))


def _index(rows: DataFrame, ranges: str) -> DataFrame:
    out = rows.withColumn("plus_di", F.coalesce(100 * fr.div("_p", ranges), F.lit(0.0))).withColumn("minus_di", F.coalesce(100 * fr.div("_m", ranges), F.lit(0.0)))
    out = out.withColumn("_dx", F.coalesce(100 * fr.div(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")), F.lit(0.0)))
    return out.drop("_up", "_down", "_plus", "_minus", "_p", "_m")


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional movement against the true range, and the recursive mean of its index."""
    moves = _directions(bars.withColumn("_tr", true_range()))
    out = fr.ema(moves, {"_p": ("_plus", n), "_m": ("_minus", n)}, by="_plus")
    return fr.ema(_index(fr.ema(out, {"_a": ("_tr", n)}), "_a"), {"adx": ("_dx", n)}).drop("_tr", "_a", "_dx")


def matrix(bars: DataFrame, n: int = 14) -> DataFrame:
    """All technical features of bars without nulls: as ``rsi``, ``macd``, ``bollinger``, ``atr``, ``stochastic``, ``adx``, ``obv`` and ``vwap``
    one after the other, but averages that do not need each other are taken together, so that their sorts are shared."""
    out = _directions(_gains(bars).withColumn("_tr", true_range()))
    spans = {"_g": ("_gain", n), "_l": ("_loss", n), "_f": ("close", 12), "_s": ("close", 26), "atr": ("_tr", n), "_p": ("_plus", n), "_m": ("_minus", n)}
    out = _index(_strength(fr.ema(out, spans, by="close")), "atr").withColumn("macd", F.col("_f") - F.col("_s"))
    out = fr.ema(out, {"macd_signal": ("macd", 9), "adx": ("_dx", n)}, by="close").withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    return vwap(obv(stochastic(bollinger(out.drop("_tr", "_f", "_s", "_dx")))))


def obv(bars: DataFrame, n: int = 20) -> DataFrame:
    """Cumulative volume signed by the change of the close, and its mean over n rows."""
    sign = F.coalesce(F.signum(F.col("close") - fr.lag("close")), F.lit(0.0))
    return bars.withColumn("_v", sign * F.col("volume")).withColumn("obv", F.sum("_v").over(fr.so_far())).withColumn("obv_mean", fr.rolling("mean", "obv", n)).drop("_v")


def vwap(bars: DataFrame) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return bars.withColumn("vwap", fr.div(F.sum(typical * F.col("volume")).over(fr.so_far()), F.sum("volume").over(fr.so_far())))


def price_features(bars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Returns, volatilities, distances from means, range position, gap, volume ratio and shares of rising days."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_up", F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double")))
    low, high = fr.rolling("min", "low", 20), fr.rolling("max", "high", 20)
    return out.select(
        "symbol", "date", *keep, F.col("ret").alias("ret_1"), fr.change("close", 5).alias("ret_5"), fr.change("close", 21).alias("ret_21"),
        *(fr.rolling("std", "ret", n).alias(f"vol_{n}") for n in (10, 21, 63)),
        *((fr.div("close", fr.rolling("mean", "close", n)) - 1).alias(f"from_mean_{n}") for n in (10, 20, 50)),
        (fr.div(fr.rolling("mean", "close", 10), fr.rolling("mean", "close", 50)) - 1).alias("cross_10_50"),
        fr.div(F.col("close") - low, high - low).alias("range_position"), (fr.div("open", fr.lag("close")) - 1).alias("gap"), fr.div("volume", fr.rolling("mean", "volume", 20)).alias("volume_ratio"),
        *(fr.rolling("mean", "_up", n).alias(f"up_share_{n}") for n in (10, 20)),
    )


def regime_features(bars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Annualised volatility and its z, momentum, drawdown, trend strength, lag-1 autocorrelation, skewness, kurtosis."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_before", fr.lag("ret"))
    out = fr.moments(out, "ret", {"_vol": ("std", 20, 20), "_mean": ("mean", 60, 60), "_std": ("std", 60, 60), "_enough": ("sum", 60, 60)})
    out = fr.moments(out, "ret", {"skew": ("skew", 60, 60), "kurt": ("kurt", 60, 60)})
    out = fr.moments(out.withColumn("vol", F.col("_vol") * F.sqrt(F.lit(252.0))), "vol", {"_vm": ("mean", 252, 60), "_vs": ("std", 252, 60)})
    out = fr.rolling_correlation(fr.rolling_max(out, "_peak", "close", 252), "_autocorr", "ret", "_before", 59)
    return out.select(
        "symbol", "date", *keep, "vol", fr.div(F.col("vol") - F.col("_vm"), "_vs").alias("vol_z"), fr.change("close", 63).alias("momentum"), (fr.div("close", "_peak") - 1).alias("drawdown"),
        fr.div(F.abs("_mean"), "_std").alias("trend_strength"), F.when(F.col("_enough").isNotNull(), F.col("_autocorr")).alias("autocorr"), "skew", "kurt",
    )


def momentum_quality(bars: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    def step(x: dict[str, np.ndarray]) -> None:
        ret = ar.div(x["close"], ar.lag(x["close"])) - 1
        m, _, square = ar.moments(ret, 63)
        x["sign_consistency"] = ar.mean(np.sign(ret), 21)
        x["vol_adjusted"] = np.where(m >= 63, ar.div(ar.total(ret, 63), np.sqrt(square / 62)), np.nan)
        x["skew_21"], x["skew_63"] = ar.corrected_skew(ret, 21), ar.corrected_skew(ret, 63)

    added = ["sign_consistency", "vol_adjusted", "skew_21", "skew_63"]
    return ar.along(bars.select("symbol", "date", *dict.fromkeys([*keep, "close"])), ["close"], added, step).select("symbol", "date", *keep, *added)


def forward_label(bars: DataFrame, horizon: int = 5, warm_up: int = 20) -> DataFrame:
    """Return over the next rows and its sign; the tail without one and the first ``warm_up`` rows are dropped."""
    out = bars.withColumn("forward_return", fr.div(fr.lead("close", horizon), "close") - 1).withColumn("_rn", F.row_number().over(fr.series()))
    return out.where((F.col("_rn") > warm_up) & F.col("forward_return").isNotNull()).select("symbol", "date", "forward_return", (F.col("forward_return") > 0).cast("int").alias("label"))


def rolling_beta(own: str, other: str, n: int = 63) -> Column:
    """Population covariance over variance, from max(10, n / 4) pairs on."""
    w = fr.last_rows(n)
    both = F.col(own).isNotNull() & F.col(other).isNotNull()
    a, b = F.when(both, F.col(own)), F.when(both, F.col(other))
    return F.when(F.count(a).over(w) >= max(10, n // 4), fr.div(F.covar_pop(a, b).over(w), F.var_pop(b).over(w)))


def drawdown(rows: DataFrame, ret: str = "ret") -> DataFrame:
    """Growth of 1 and the distance from its maximum so far; returns of -1 or less count as -0.999999."""
    growth = F.exp(F.sum(F.log1p(F.greatest(F.coalesce(F.col(ret), F.lit(0.0)), F.lit(-0.999999)))).over(fr.so_far()))
    return rows.withColumn("growth", growth).withColumn("drawdown", fr.div("growth", F.greatest(F.max("growth").over(fr.so_far()), F.lit(1.0))) - 1)


def drawdown_periods(rows: DataFrame, threshold: float = -0.1) -> DataFrame:
    """Stretches below the threshold: start, end, depth, rows. One that still lasts is left out."""
    below = (F.col("drawdown") < threshold).cast("int")
    flagged = rows.withColumn("_in", below).withColumn("_island", F.sum((F.col("_in") != F.coalesce(fr.lag("_in"), F.lit(0))).cast("int")).over(fr.so_far())).withColumn("_last", F.max("date").over(fr.across("symbol")))
    out = flagged.where("_in = 1").groupBy("symbol", "_island").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min("drawdown").alias("depth"), F.count("*").alias("n_rows"), F.max("_last").alias("_last"))
    return out.where(F.col("end_date") < F.col("_last")).drop("_last", "_island")


def longest_runs(rows: DataFrame, ret: str = "ret") -> DataFrame:
    """Most wins and most losses in a row, rows without a move removed."""
    moves = rows.where(F.col(ret).isNotNull() & (F.col(ret) != 0)).withColumn("_w", F.col(ret) > 0)
    runs = moves.withColumn("_run", F.sum((~F.col("_w").eqNullSafe(fr.lag("_w"))).cast("int")).over(fr.so_far()))
    sizes = runs.groupBy("symbol", "_run", "_w").agg(F.count("*").alias("n"))
    return sizes.groupBy("symbol").agg(F.max(F.when(F.col("_w"), F.col("n")).otherwise(0)).alias("max_wins"), F.max(F.when(~F.col("_w"), F.col("n")).otherwise(0)).alias("max_losses"))


def streak(rows: DataFrame, x: str) -> DataFrame:
    """Signed length of the run of equal signs; 0 where x is 0."""
    signed = rows.withColumn("_s", F.signum(F.coalesce(F.col(x), F.lit(0.0)))).withColumn("_run", F.sum((~F.col("_s").eqNullSafe(fr.lag("_s"))).cast("int")).over(fr.so_far()))
    return signed.withColumn("streak", (F.col("_s") * F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("date"))).cast("long")).drop("_s", "_run")


def standardised_surprise(rows: DataFrame, x: str, n: int = 8) -> DataFrame:
    """(x - mean of the n rows before) / their population deviation."""
    w = fr.series().rowsBetween(-n, -1)
    return rows.withColumn("sue", F.when(F.count(x).over(w) >= n, fr.div(F.col(x) - F.avg(x).over(w), F.stddev_pop(x).over(w))))


def rolling_quantile(rows: DataFrame, x: str, q: float, n: int) -> DataFrame:
    w = fr.last_rows(n)
    return rows.withColumn("quantile", F.when(F.count(x).over(w) >= n, F.percentile(x, F.lit(q)).over(w)))


def rolling_slope(rows: DataFrame, x: str, n: int) -> DataFrame:
    """Least-squares slope of x on the row number over the last n rows."""
    numbered = rows.withColumn("_rn", F.row_number().over(fr.series()).cast("double"))
    w = fr.last_rows(n)
    return numbered.withColumn("slope", F.when(F.count(x).over(w) >= n, F.regr_slope(F.col(x), F.col("_rn")).over(w))).drop("_rn")


def windows_to_arrays(rows: DataFrame, column: str, window: int, horizon: int, step: int) -> DataFrame:
    """Every ``step`` rows: the last ``window`` values as an array and the value ``horizon`` rows ahead."""
    w = fr.last_rows(window)
    out = rows.withColumn("_rn", F.row_number().over(fr.series())).withColumn("sample", F.collect_list(column).over(w)).withColumn("target", fr.lead(column, horizon))
    return out.where((F.col("_rn") >= window) & ((F.col("_rn") - window) % step == 0) & F.col("target").isNotNull()).select("symbol", "date", "sample", "target")
