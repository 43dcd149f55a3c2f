"""Daily sentiment of scored articles, and what prices alone imply of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr

#: Columns of ``daily_features`` after the keys.
DAILY = "mean_sentiment sentiment_std max_positive max_negative n_articles weighted_sentiment high_confidence_sent bullish_ratio bearish_ratio neutral_ratio news_volume_surprise sentiment_ma3 sentiment_ma7 sentiment_momentum_3d sentiment_momentum_7d sentiment_dispersion".split()


def daily_features(articles: DataFrame) -> DataFrame:
    """Sixteen features per symbol and date of articles (symbol, date, score, confidence, label, weight).

    One partial aggregation, then windows over one row per symbol and date. A day with one article has no deviation: 0. Without
    confident articles (over 0.7) the mean stands in; momenta are 0 until there are enough days. Articles
    without a score only count for the labels.
    """
    share = lambda label: fr.div(F.count_if(F.col("label") == label), F.count("score"))
    scored = F.col("score").isNotNull()
    out = articles.groupBy("symbol", "date").agg(
        F.avg("score").alias("mean_sentiment"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sentiment_std"), F.max("score").alias("max_positive"), F.min("score").alias("max_negative"), F.count("score").alias("n_articles"),
        fr.div(F.sum(F.col("weight") * F.col("score")), F.sum(F.when(scored, F.col("weight")))).alias("weighted_sentiment"), F.coalesce(F.avg(F.when(F.col("confidence") > 0.7, F.col("score"))), F.avg("score")).alias("high_confidence_sent"),
        share("positive").alias("bullish_ratio"), share("negative").alias("bearish_ratio"), share("neutral").alias("neutral_ratio"),
    )
    zero = F.lit(0.0)
    out = out.withColumns({
        "news_volume_surprise": F.coalesce(fr.div("n_articles", fr.rolling("mean", "n_articles", 7, 1)) - 1, zero), "sentiment_ma3": fr.rolling("mean", "mean_sentiment", 3, 1), "sentiment_ma7": fr.rolling("mean", "mean_sentiment", 7, 1),
        "sentiment_momentum_3d": F.coalesce(F.col("mean_sentiment") - fr.lag("mean_sentiment", 3), zero), "sentiment_momentum_7d": F.coalesce(F.col("mean_sentiment") - fr.lag("mean_sentiment", 7), zero),
        "sentiment_dispersion": F.col("max_positive") - F.col("max_negative"),
    })
    return out.select("symbol", "date", *(F.coalesce(F.col(c), F.lit(0)).alias(c) if c == "n_articles" else F.coalesce(F.col(c), zero).alias(c) for c in DAILY))


def on_calendar(features: DataFrame, calendar: DataFrame) -> DataFrame:
    """The features on the calendar's rows (symbol, date): the last of its rows that has them, 0 before; no other days count."""
    met = calendar.select("symbol", "date").join(features, ["symbol", "date"], "left")
    return met.select("symbol", "date", *(F.coalesce(F.last(c, True).over(fr.so_far()), F.lit(0)).alias(c) for c in features.columns if c not in ("symbol", "date")))


def _least(x: Column, low: float) -> Column:
    """x, raised to ``low``; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def price_proxies(bars: DataFrame) -> DataFrame:
    """Sixteen proxies of news per symbol from bars alone, over one window by symbol; null until a frame is full.

    Overnight gaps, their z and how often the day takes them back; surprises of range and volume and their product; acceleration; a score
    of the gap that doubles on high volume, its means and their difference; fear and greed; z and clustering of returns; consistency
    of direction; volume against the move.
    """
    out = bars.withColumns({"ret": fr.change("close"), "overnight_gap": fr.div("open", fr.lag("close")) - 1, "_range": fr.div(F.col("high") - F.col("low"), "close")})
    gap, ret = F.col("overnight_gap"), F.col("ret")
    back = F.when(F.coalesce(gap, F.lit(0.0)) > 0, F.col("close") < F.col("open")).otherwise(F.col("close") > F.col("open"))
    out = out.withColumns({
        "overnight_gap_zscore": (gap - fr.rolling("mean", gap, 20)) / _least(fr.rolling("std", gap, 20), 1e-8),
        "range_surprise": F.col("_range") / _least(fr.rolling("mean", "_range", 20), 1e-8) - 1, "volume_surprise": F.col("volume") / _least(fr.rolling("mean", "volume", 20), 1.0) - 1,
        "returns_accel": ret - fr.lag("ret"), "_back": back.cast("double"), "_rose": F.coalesce((ret > 0).cast("double"), F.lit(0.0)),
        "return_zscore": (ret - fr.rolling("mean", ret, 14)) / _least(fr.rolling("std", ret, 14), 1e-8), "vol_regime": fr.rolling("std", ret, 10) / _least(fr.rolling("std", ret, 40), 1e-8),
    })
    heat = _least(F.col("range_surprise"), 0.0) * _least(F.col("volume_surprise"), 0.0)
    out = out.withColumns({
        "sentiment_proxy": fr.clip(F.when(F.col("volume_surprise") > 0.5, gap * 10).otherwise(gap * 5), -3.0, 3.0), "news_intensity": fr.clip(heat, 0.0, 10.0), "fear_greed": F.when(ret < 0, -heat).otherwise(heat),
        "trend_strength": (fr.rolling("mean", "_rose", 10) - 0.5) * 2, "vol_price_div": F.col("volume_surprise") * F.signum(-ret), "gap_fill_rate": fr.rolling("mean", "_back", 20),
    })
    out = out.withColumns({"sentiment_ma3": fr.rolling("mean", "sentiment_proxy", 3), "sentiment_ma7": fr.rolling("mean", "sentiment_proxy", 7)})
    names = "overnight_gap overnight_gap_zscore range_surprise volume_surprise returns_accel sentiment_proxy sentiment_ma3 sentiment_ma7 sentiment_momentum news_intensity fear_greed return_zscore vol_regime trend_strength vol_price_div gap_fill_rate".split()
    return out.withColumn("sentiment_momentum", F.col("sentiment_ma3") - F.col("sentiment_ma7")).select("symbol", "date", *names)
