"""Microstructure, path-shape and closed-form distribution features: windows over rows, no simulation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr

LN2 = math.log(2.0)


def quote_spread(quotes: DataFrame, n: int = 5) -> DataFrame:
    mid = (F.col("bid") + F.col("ask")) / 2
    out = quotes.withColumn("mid", mid).withColumn("spread", F.col("ask") - F.col("bid")).withColumn("relative_spread", fr.div("spread", "mid"))
    return out.withColumn("spread_mean", fr.rolling("mean", "spread", n, 1, order="ts"))


def roll_spread(bars: DataFrame, n: int = 20) -> DataFrame:
    """2 sqrt(-cov(r, r before)) over n - 1 pairs; 0 where the covariance is not negative."""
    out = bars.withColumn("_r", fr.change("close")).withColumn("_b", fr.lag("_r"))
    w = fr.last_rows(n - 1)
    both = F.col("_r").isNotNull() & F.col("_b").isNotNull()
    cov = F.when(F.count(F.when(both, 1)).over(w) >= n - 1, F.covar_samp(F.when(both, F.col("_r")), F.when(both, F.col("_b"))).over(w))
    return out.withColumn("_cov", cov).withColumn("roll_spread", F.when(F.col("_cov").isNotNull(), 2 * F.sqrt(F.greatest(-F.col("_cov"), F.lit(0.0))))).drop("_r", "_b", "_cov")


def high_low_spread(bars: DataFrame) -> DataFrame:
    """The two-day high-low estimator; negative values are 0."""
    hl = F.pow(F.log(F.col("high") / F.col("low")), 2)
    out = bars.withColumn("_beta", hl + fr.lag(hl)).withColumn("_gamma", F.pow(F.log(F.greatest("high", fr.lag("high")) / F.least("low", fr.lag("low"))), 2))
    k = 3 - 2 * math.sqrt(2.0)
    out = out.withColumn("_alpha", (F.sqrt(2 * F.col("_beta")) - F.sqrt("_beta")) / k - F.sqrt(F.col("_gamma") / k))
    spread = 2 * (F.exp(F.least("_alpha", F.lit(50.0))) - 1) / (1 + F.exp(F.least("_alpha", F.lit(50.0))))
    return out.withColumn("high_low_spread", F.when(F.col("_beta").isNotNull(), F.greatest(spread, F.lit(0.0)))).drop("_alpha", "_beta", "_gamma")


def close_mid_spread(bars: DataFrame) -> DataFrame:
    """From the close and the mid-ranges of this row and the next one, which it therefore looks ahead to."""
    mid = (F.log("high") + F.log("low")) / 2
    out = bars.withColumn("_m", mid)
    value = 4 * (F.log("close") - F.col("_m")) * (F.log("close") - fr.lead("_m"))
    return out.withColumn("_v", value).withColumn("close_mid_spread", F.when(F.col("_v").isNotNull(), F.sqrt(F.greatest("_v", F.lit(0.0))))).drop("_m", "_v")


def bar_flow(bars: DataFrame, n: int = 10) -> DataFrame:
    """Close location times volume, its sum so far, mean and change."""
    location = F.coalesce(fr.div(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    out = bars.withColumn("flow", location * F.col("volume"))
    return out.withColumn("flow_cum", F.sum("flow").over(fr.so_far())).withColumn("flow_mean", fr.rolling("mean", "flow", n)).withColumn("flow_momentum", F.col("flow_mean") - fr.lag("flow_mean", n))


def flow_signal(bars: DataFrame, n: int = 20, limit: float = 2.0) -> DataFrame:
    out = bar_flow(bars).withColumn("flow_z", fr.zscore("flow", n))
    return out.withColumn("signal", F.when(F.col("flow_z") > limit, 1).when(F.col("flow_z") < -limit, -1).otherwise(0))


def tick_rule(trades: DataFrame) -> DataFrame:
    """Sign of the price change; equal prices carry the last sign on, 1 before any change."""
    out = trades.withColumn("_s", F.signum(F.col("price") - F.lag("price").over(Window.partitionBy("symbol").orderBy("ts", "event_id"))))
    w = Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("tick_sign", F.coalesce(F.last(F.when(F.col("_s") != 0, F.col("_s")), True).over(w), F.lit(1.0)).cast("int")).drop("_s")


def quote_rule(matched: DataFrame) -> DataFrame:
    """Above the mid is a purchase, below a sale; at it, or without a quote, the tick rule decides."""
    out = tick_rule(matched).withColumn("_mid", (F.col("bid") + F.col("ask")) / 2)
    return out.withColumn("sign", F.when(F.col("price") > F.col("_mid"), 1).when(F.col("price") < F.col("_mid"), -1).otherwise(F.col("tick_sign"))).drop("_mid")


def bulk_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    """Share of the volume bought, the normal distribution function of the standardised price change."""
    out = bars.withColumn("_d", F.col("close") - fr.lag("close")).withColumn("_sd", fr.rolling("std", "_d", n))
    return out.withColumn("buy_share", fr.norm_cdf(fr.div("_d", "_sd"))).withColumn("buy_volume", F.col("buy_share") * F.col("volume")).withColumn("imbalance", 2 * F.col("buy_share") - 1).drop("_d", "_sd")


def range_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """Five volatility estimators over the last n rows."""
    ho, lo, co = F.log(F.col("high") / F.col("open")), F.log(F.col("low") / F.col("open")), F.log(F.col("close") / F.col("open"))
    hl = F.log(F.col("high") / F.col("low"))
    out = bars.withColumn("_r", F.log(F.col("close") / fr.lag("close"))).withColumn("_o", F.log(F.col("open") / fr.lag("close")))
    out = out.withColumn("_pk", hl * hl / (4 * LN2)).withColumn("_gk", 0.5 * hl * hl - (2 * LN2 - 1) * co * co).withColumn("_rs", ho * (ho - co) + lo * (lo - co)).withColumn("_c", co)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    out = out.select("symbol", "date", fr.rolling("std", "_r", n).alias("vol_close"), *(F.when(fr.rolling("mean", c, n).isNotNull(), root(fr.rolling("mean", c, n))).alias(a) for c, a in (("_pk", "vol_parkinson"), ("_gk", "vol_garman_klass"), ("_rs", "vol_rogers_satchell"))),
                     (fr.rolling("var", "_o", n) + k * fr.rolling("var", "_c", n) + (1 - k) * fr.rolling("mean", "_rs", n)).alias("_yz"))
    return out.withColumn("vol_yang_zhang", F.when(F.col("_yz").isNotNull(), root(F.col("_yz")))).drop("_yz")


def whole_volatility(bars: DataFrame, periods: int = 252) -> DataFrame:
    hl = F.log(F.col("high") / F.col("low"))
    rows = bars.withColumn("_r", F.log(F.col("close") / fr.lag("close")))
    return rows.groupBy("symbol").agg((F.stddev_samp("_r") * math.sqrt(periods)).alias("vol_close"), F.sqrt(F.avg(hl * hl) / (4 * LN2) * periods).alias("vol_parkinson"))


def signature(bars: DataFrame, steps: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """Deviation of log returns that are sampled every f rows, over sqrt(f)."""
    rows = bars.select("symbol", "date", "close", F.row_number().over(fr.series()).alias("_rn")).withColumn("step", F.explode(F.array(*map(F.lit, steps)))).where("_rn % step = 0")
    w = Window.partitionBy("symbol", "step").orderBy("date")
    out = rows.withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    return out.groupBy("symbol", "step").agg((F.stddev_samp("_r") / F.sqrt(F.col("step").cast("double"))).alias("vol"))


def best_step(signatures: DataFrame) -> DataFrame:
    """The step after which the volatility changes least."""
    w = Window.partitionBy("symbol").orderBy("step")
    out = signatures.withColumn("_d", F.abs(F.col("vol") - F.lag("vol").over(w))).where("_d is not null")
    return out.groupBy("symbol").agg(F.min_by("step", F.struct("_d", "step")).alias("step"))


def path_shape(bars: DataFrame, n: int = 21) -> DataFrame:
    """Skewness, kurtosis, downside deviation, tail ratio and share of jumps over the last n returns."""
    out = bars.withColumn("ret", fr.change("close"))
    w = fr.last_rows(n)
    full = F.count("ret").over(w) >= n
    down = F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).when(F.col("ret").isNotNull(), 0.0)
    q = F.percentile("ret", F.array(F.lit(0.95), F.lit(0.05))).over(w)  # a frame is sorted once
    return out.withColumns({"_down": down, "_q": q}).select(
        "symbol", "date", F.when(full, fr.corrected_skew("ret", w)).alias("skew"), F.when(full, fr.corrected_kurtosis("ret", w)).alias("kurt"), F.when(full, F.sqrt(F.avg("_down").over(w))).alias("downside"),
        F.when(full, fr.div(F.abs(F.col("_q")[0]), F.abs(F.col("_q")[1]))).alias("tail_ratio"), F.when(full, fr.div(F.max(F.abs("ret")).over(w), F.sum(F.abs("ret")).over(w))).alias("jumpiness"),
    )


def katz_dimension(bars: DataFrame, n: int = 30) -> DataFrame:
    """log(steps) / (log(steps) + log(diameter / length)) of the path over the last n rows."""
    w = fr.last_rows(n)
    out = bars.withColumn("_d", F.abs(F.col("close") - fr.lag("close")))
    frame = F.collect_list("close").over(w)
    inner = fr.last_rows(n - 1)
    rows = out.withColumn("_len", F.sum("_d").over(inner)).withColumn("_x", frame).where(F.size("_x") == n)
    diameter = F.array_max(F.transform("_x", lambda v: F.abs(v - F.col("_x")[0])))
    steps = math.log(n - 1)
    ratio = fr.div(diameter, F.col("_len"))
    return rows.select("symbol", "date", F.when(ratio > 0, fr.div(F.lit(steps), steps + F.log(ratio))).alias("katz"))


def permutation_entropy(bars: DataFrame, n: int = 30) -> DataFrame:
    """Entropy in bits of the order patterns of three neighbouring closes over the last n rows, over its maximum log2 6."""
    a, b, c = fr.lag("close", 2), fr.lag("close"), F.col("close")
    pattern = F.when(a.isNull(), None).otherwise((a > b).cast("int") * 4 + (b > c).cast("int") * 2 + (a > c).cast("int"))
    out = bars.withColumn("_p", pattern)
    w = fr.last_rows(n)
    total = F.count("_p").over(w).cast("double")
    entropy = F.lit(0.0)
    for k in range(8):
        share = F.count(F.when(F.col("_p") == k, 1)).over(w) / F.nullif(total, F.lit(0.0))
        entropy = entropy - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return out.select("symbol", "date", F.when(F.count("_p").over(w) >= n - 2, entropy / math.log2(6)).alias("permutation_entropy"))


def wasserstein(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean distance of the sorted returns of the last n rows and the n rows before them."""
    out = bars.withColumn("ret", fr.change("close"))
    now, before = fr.last_rows(n), fr.series().rowsBetween(1 - 2 * n, -n)
    rows = out.withColumn("_a", F.array_sort(F.collect_list("ret").over(now))).withColumn("_b", F.array_sort(F.collect_list("ret").over(before))).where((F.size("_a") == n) & (F.size("_b") == n))
    distance = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / n
    return rows.select("symbol", "date", distance.alias("wasserstein"))


def haar_energy(bars: DataFrame, n: int = 32) -> DataFrame:
    """Shares of the energy of n returns in the finest and next details of a Haar transform, and in the rest."""
    rows = bars.withColumn("ret", fr.change("close")).withColumn("_x", F.collect_list("ret").over(fr.last_rows(n))).where(F.size("_x") == n)
    half = F.sequence(F.lit(0), F.lit(n // 2 - 1))
    quarter = F.sequence(F.lit(0), F.lit(n // 4 - 1))
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    rows = rows.withColumn("_a", F.transform(half, lambda i: (F.get("_x", 2 * i) + F.get("_x", 2 * i + 1)) / math.sqrt(2))).withColumn("_d", F.transform(half, lambda i: (F.get("_x", 2 * i) - F.get("_x", 2 * i + 1)) / math.sqrt(2)))
    rows = rows.withColumn("_d2", F.transform(quarter, lambda i: (F.get("_a", 2 * i) - F.get("_a", 2 * i + 1)) / math.sqrt(2))).withColumn("_e", energy(F.col("_x")))
    out = rows.withColumn("noise_share", fr.div(energy(F.col("_d")), "_e")).withColumn("detail_share", fr.div(energy(F.col("_d2")), "_e"))
    return out.select("symbol", "date", "noise_share", "detail_share", (1 - F.col("noise_share") - F.col("detail_share")).alias("trend_share"))


def closed_form_paths(bars: DataFrame, n: int = 60, horizon: int = 20) -> DataFrame:
    """From the drift and deviation of n log returns: mean growth, probabilities of a rise and of +-5 %, value at risk."""
    rows = bars.withColumn("_r", F.log(F.col("close") / fr.lag("close"))).withColumn("_m", fr.rolling("mean", "_r", n) * horizon).withColumn("_s", fr.rolling("std", "_r", n) * math.sqrt(horizon))
    above = lambda x: 1 - fr.norm_cdf(fr.div(math.log(1 + x) - F.col("_m"), "_s"))
    return rows.select("symbol", "date", (F.exp(F.least(F.col("_m") + F.col("_s") * F.col("_s") / 2, F.lit(5.0))) - 1).alias("mean_growth"), above(0.0).alias("p_up"), above(0.05).alias("p_up_5"), (1 - above(-0.05)).alias("p_down_5"), (1 - F.exp(F.col("_m") - 1.6448536269514722 * F.col("_s"))).alias("var_95"))


def ou_parameters(bars: DataFrame) -> DataFrame:
    """Least squares of the change of the log close on its level: speed, mean, and half-life of a mean-reverting process."""
    rows = bars.withColumn("_x", F.log("close")).withColumn("_b", fr.lag("_x")).withColumn("_d", F.col("_x") - F.col("_b")).where("_d is not null")
    out = rows.groupBy("symbol").agg(F.regr_slope("_d", "_b").alias("_k"), F.regr_intercept("_d", "_b").alias("_i"), F.count("*").alias("n"))
    theta = -F.col("_k")
    return out.select("symbol", "n", theta.alias("theta"), F.when(theta > 0, fr.div("_i", theta)).alias("mu"), F.when(theta > 0, LN2 / theta).alias("half_life"))


def option_values(chain: DataFrame, rate: float = 0.02) -> DataFrame:
    """Closed-form call value and greeks of columns spot, strike, years and sigma."""
    root = F.col("sigma") * F.sqrt("years")
    d1 = (F.log(F.col("spot") / F.col("strike")) + (rate + F.col("sigma") * F.col("sigma") / 2) * F.col("years")) / root
    d2 = d1 - root
    discount = F.exp(-rate * F.col("years"))
    density: Column = F.exp(-d1 * d1 / 2) / math.sqrt(2 * math.pi)
    call = F.col("spot") * fr.norm_cdf(d1) - F.col("strike") * discount * fr.norm_cdf(d2)
    return chain.withColumns({"call": call, "put": call - F.col("spot") + F.col("strike") * discount, "delta": fr.norm_cdf(d1), "gamma": density / (F.col("spot") * root), "vega": F.col("spot") * density * F.sqrt("years")})
