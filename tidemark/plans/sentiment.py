"""Queries of daily sentiment, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import clip, rounded
from ..operators import sentiment as s
from ..sources import market as m
from .registry import query, sql
from .technical import W, r, roll

KEYS = ["symbol", "date"]

SCORED = """sa AS (SELECT symbol, date, least(greatest((n_chars - 2000) / 2000.0, -1.0), 1.0) AS score, CASE WHEN regexp_matches(source, '[02468]$') THEN 2.0 ELSE 1.0 END AS weight FROM articles),
sb AS (SELECT *, abs(score) AS confidence, CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM sa)"""


def scored(spark, sf_dir):
    """Articles with a score that their size stands in for, its strength as confidence, a label, and a weight by source."""
    rows = m.articles(spark, sf_dir).select(*KEYS, clip((F.col("n_chars") - 2000) / 2000.0, -1.0, 1.0).alias("score"), F.when(F.col("source").rlike("[02468]$"), 2.0).otherwise(1.0).alias("weight"))
    return rows.withColumns({"confidence": F.abs("score"), "label": F.when(F.col("score") > 0.1, "positive").when(F.col("score") < -0.1, "negative").otherwise("neutral")})


DAILY = f"""{SCORED}, sc AS (SELECT symbol, date, avg(score) AS mean_sentiment, coalesce(stddev_samp(score), 0.0) AS sentiment_std, max(score) AS max_positive, min(score) AS max_negative, count(score) AS n_articles, sum(weight * score) / nullif(sum(weight) FILTER (score IS NOT NULL), 0) AS weighted_sentiment,
coalesce(avg(score) FILTER (confidence > 0.7), avg(score)) AS high_confidence_sent, {', '.join(f"count(*) FILTER (label = '{x}') / nullif(count(score), 0) AS {y}_ratio" for x, y in (('positive', 'bullish'), ('negative', 'bearish'), ('neutral', 'neutral')))} FROM sb GROUP BY 1, 2),
sd AS (SELECT *, n_articles / nullif(({roll('avg', 'n_articles', 7, 1)}), 0) - 1 AS news_volume_surprise, {roll('avg', 'mean_sentiment', 3, 1)} AS sentiment_ma3, {roll('avg', 'mean_sentiment', 7, 1)} AS sentiment_ma7, mean_sentiment - lag(mean_sentiment, 3) OVER w AS sentiment_momentum_3d, mean_sentiment - lag(mean_sentiment, 7) OVER w AS sentiment_momentum_7d, max_positive - max_negative AS sentiment_dispersion FROM sc {W}),
se AS (SELECT symbol, date, n_articles, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in s.DAILY if c != 'n_articles')} FROM sd)"""


@query("A10_daily_sentiment", sql("articles", f", {DAILY} SELECT symbol, date, n_articles, {r(**{c: c for c in s.DAILY if c != 'n_articles'})} FROM se"))
def daily_features(spark, sf_dir):
    return rounded(s.daily_features(scored(spark, sf_dir)), *KEYS)


FILL = "(PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("A10_sentiment_on_calendar", sql("articles bars", f", {DAILY}, sf AS (SELECT bars.symbol, bars.date, se.* EXCLUDE (symbol, date) FROM bars LEFT JOIN se ON bars.symbol = se.symbol AND bars.date = se.date) SELECT symbol, date, coalesce(last_value(n_articles IGNORE NULLS) OVER {FILL}, 0) AS n_articles, {r(**{c: f'coalesce(last_value({c} IGNORE NULLS) OVER {FILL}, 0.0)' for c in s.DAILY if c != 'n_articles'})} FROM sf"))
def sentiment_on_calendar(spark, sf_dir):
    return rounded(s.on_calendar(s.daily_features(scored(spark, sf_dir)), m.daily_bars(spark, sf_dir)), *KEYS)


def raised(x: str, low: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({x}, {low}) END"


@query("W18_price_proxies", sql("rets", f""", pa AS (SELECT *, open / nullif(lag(close) OVER w, 0) - 1 AS gap, (high - low) / nullif(close, 0) AS rg, ret - lag(ret) OVER w AS accel FROM rets {W}),
pb AS (SELECT *, CASE WHEN coalesce(gap, 0.0) > 0 THEN CAST(close < open AS DOUBLE) ELSE CAST(close > open AS DOUBLE) END AS back, coalesce(CAST(ret > 0 AS DOUBLE), 0.0) AS rose,
(gap - ({roll('avg', 'gap', 20)})) / ({raised(roll('stddev_samp', 'gap', 20), 1e-8)}) AS gz, rg / ({raised(roll('avg', 'rg', 20), 1e-8)}) - 1 AS rs, volume / ({raised(roll('avg', 'volume', 20), 1.0)}) - 1 AS vs FROM pa),
pc AS (SELECT *, least(greatest(CASE WHEN vs > 0.5 THEN gap * 10 ELSE gap * 5 END, CASE WHEN gap IS NOT NULL THEN -3.0 END), CASE WHEN gap IS NOT NULL THEN 3.0 END) AS sp, ({raised('rs', 0.0)}) * ({raised('vs', 0.0)}) AS heat FROM pb),
pd AS (SELECT *, {roll('avg', 'sp', 3)} AS m3, {roll('avg', 'sp', 7)} AS m7 FROM pc)
SELECT symbol, date, {r(overnight_gap='gap', overnight_gap_zscore='gz', range_surprise='rs', volume_surprise='vs', returns_accel='accel', sentiment_proxy='sp', sentiment_ma3='m3', sentiment_ma7='m7', sentiment_momentum='m3 - m7', news_intensity='CASE WHEN heat IS NOT NULL THEN least(heat, 10.0) END', fear_greed='CASE WHEN ret < 0 THEN -heat ELSE heat END',
return_zscore=f"(ret - ({roll('avg', 'ret', 14)})) / ({raised(roll('stddev_samp', 'ret', 14), 1e-8)})", vol_regime=f"({roll('stddev_samp', 'ret', 10)}) / ({raised(roll('stddev_samp', 'ret', 40), 1e-8)})", trend_strength=f"(({roll('avg', 'rose', 10)}) - 0.5) * 2", vol_price_div='vs * sign(-ret)', gap_fill_rate=roll('avg', 'back', 20))} FROM pd"""))
def price_proxies(spark, sf_dir):
    return rounded(s.price_proxies(m.daily_bars(spark, sf_dir)), *KEYS)
