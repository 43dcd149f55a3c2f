"""Weights, sizes, costs and portfolio risk as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr


def position_sizes(rows: DataFrame, capital: float, risk: float, multiple: float) -> DataFrame:
    """capital * risk over the distance atr * multiple."""
    return rows.withColumn("size", fr.div(F.lit(capital * risk), F.col("atr") * multiple))


def project(book: DataFrame, most: float, gross: float) -> DataFrame:
    """Clip each weight of (date, symbol), scale to the gross limit, shift the mean to 0, clip again."""
    w = fr.across("date")
    out = book.withColumn("w", fr.clip("weight", -most, most))
    out = out.withColumn("_g", F.sum(F.abs("w")).over(w)).withColumn("w", F.when(F.col("_g") > gross, F.col("w") * gross / F.col("_g")).otherwise(F.col("w")))
    out = out.withColumn("w", F.col("w") - F.avg("w").over(w))
    return out.withColumn("projected", fr.clip("w", -most, most)).drop("w", "_g")


def portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    return weights.join(returns.select("symbol", "date", "ret"), ["symbol", "date"]).where("ret is not null").groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.sum(F.abs("weight")).alias("gross"))


def correlation_summary(stats: DataFrame) -> DataFrame:
    """One row over all pairs: mean and largest absolute correlation, share above 0.5."""
    known = stats.where("correlation is not null")
    return known.agg(F.count("*").alias("n"), F.avg(F.abs("correlation")).alias("average"), F.max(F.abs("correlation")).alias("largest"), F.avg((F.abs("correlation") > 0.5).cast("double")).alias("share_high"))


def diversification(book: DataFrame) -> DataFrame:
    """Effective number of names by the Herfindahl sum of shares of exposure, and the largest share."""
    shares = book.withColumn("_s", fr.div(F.abs("exposure"), F.sum(F.abs("exposure")).over(Window.partitionBy())))
    return shares.agg(F.count("*").alias("n"), fr.div(F.lit(1.0), F.sum(F.col("_s") * F.col("_s"))).alias("effective_n"), F.max("_s").alias("largest"))


def value_weights(scores: DataFrame, cap: float) -> DataFrame:
    """Weights in proportion to a positive score, capped and renormalised."""
    everything = Window.partitionBy()
    out = scores.where("score > 0").withColumn("_w", F.least(fr.div("score", F.sum("score").over(everything)), F.lit(cap)))
    return out.select("symbol", fr.div("_w", F.sum("_w").over(everything)).alias("weight"))


def slippage(fills: DataFrame, spread: float = 0.001, impact: float = 0.1, floor: float = 1.0, rate: float = 0.0005) -> DataFrame:
    """Half the spread plus impact by the root of participation, and a commission with a floor."""
    share = fr.div("quantity", "bar_volume")
    return fills.withColumn("slippage", F.col("price") * (spread / 2 + impact * F.sqrt(F.least(share, F.lit(1.0))))).withColumn("commission", F.greatest(F.col("price") * F.col("quantity") * rate, F.lit(floor)))


def learned_weights(rows: DataFrame) -> DataFrame:
    """Each signal's positive correlation with the return, normalised over the signals."""
    out = rows.groupBy("name").agg(fr.div(F.covar_samp("signal", "ret"), F.stddev_samp("signal") * F.stddev_samp("ret")).alias("_c")).withColumn("_p", F.greatest(F.coalesce("_c", F.lit(0.0)), F.lit(0.0)))
    return out.select("name", F.col("_c").alias("correlation"), F.coalesce(fr.div("_p", F.sum("_p").over(Window.partitionBy())), F.lit(0.0)).alias("weight"))


def select_trades(rows: DataFrame, threshold: float, k: int) -> DataFrame:
    """Per date: scores from the threshold on, the k best, weighted by score."""
    w = Window.partitionBy("date").orderBy(F.desc("score"), "symbol")
    best = rows.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("date", "symbol", "rank", fr.div("score", F.sum("score").over(fr.across("date"))).alias("weight"))


def two_model_blend(first: DataFrame, second: DataFrame, weight: float) -> DataFrame:
    """Both models' mean where both have a row, else the one that has."""
    out = first.select("symbol", "date", F.col("p").alias("_a")).join(second.select("symbol", "date", F.col("p").alias("_b")), ["symbol", "date"], "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return out.select("symbol", "date", F.when(both, weight * F.col("_a") + (1 - weight) * F.col("_b")).otherwise(F.coalesce("_a", "_b")).alias("p"), F.when(both, "blended").when(F.col("_a").isNotNull(), "first").otherwise("second").alias("source"))


def momentum_tilt(rows: DataFrame, strength: float) -> DataFrame:
    """Equal weights tilted by the momentum around its mean over its largest deviation, renormalised."""
    w = fr.across("date")
    out = rows.where("momentum is not null").withColumn("_d", F.col("momentum") - F.avg("momentum").over(w)).withColumn("_x", F.coalesce(fr.div("_d", F.max(F.abs("_d")).over(w)), F.lit(0.0)))
    return out.select("symbol", "date", fr.div(1 + strength * F.col("_x"), F.sum(1 + strength * F.col("_x")).over(w)).alias("weight"))


def exposure_multiplier(rows: DataFrame, warning: float = 0.1, critical: float = 0.3, breaker: float = 0.5) -> DataFrame:
    """State and exposure by the depth of the drawdown: linear between warning and breaker."""
    d = -F.col("drawdown")
    state = F.when(d >= breaker, "breaker").when(d >= critical, "critical").when(d >= warning, "warning").otherwise("normal")
    return rows.select("symbol", "date", state.alias("state"), fr.clip(1 - (d - warning) / (breaker - warning), 0.0, 1.0).alias("exposure"))
