"""Daily sentiment and event features on small panels with unknown values, and on empty ones."""

from __future__ import annotations

import datetime
import math

import pytest

from tidemark.operators import events, sentiment

DAY = datetime.date(2020, 1, 1)
ARTICLES = "symbol long, date date, score double, confidence double, label string, weight double"
EVENTS = "symbol long, date date, close double, " + ", ".join(f"{c} double" for c in events.PANEL)


def test_daily_sentiment_of_few_articles(spark):
    rows = [(1, DAY, 0.9, 0.9, "positive", 2.0), (1, DAY, -0.3, 0.3, "negative", 1.0), (1, DAY, None, None, None, 1.0), (1, DAY + datetime.timedelta(2), 0.5, 0.5, "positive", 1.0)]
    first, second = sentiment.daily_features(spark.createDataFrame(rows, ARTICLES)).orderBy("date").collect()
    assert (first.n_articles, first.mean_sentiment, first.weighted_sentiment, first.high_confidence_sent) == (2, pytest.approx(0.3), pytest.approx(0.5), 0.9)
    assert (second.sentiment_std, second.high_confidence_sent, second.bullish_ratio, second.sentiment_momentum_3d) == (0.0, 0.5, 1.0, 0.0)
    assert second.news_volume_surprise == pytest.approx(1 / 1.5 - 1)
    assert sentiment.daily_features(spark.createDataFrame([], ARTICLES)).collect() == []


def test_surprises_hold_and_fade(spark):
    rows = [(1, DAY + datetime.timedelta(10 * k), 10.0 + k, -40.0 if k == 2 else None, *[None] * 11) for k in range(16)]
    got = events.event_features(spark.createDataFrame(rows, EVENTS)).orderBy("date").collect()
    assert [r.ev_pead_strength for r in got[:2]] == [0.0, 0.0] and got[0].ev_pead_age == 1.0
    assert [r.ev_pead_strength for r in got[2:5]] == pytest.approx([-0.4, -0.4 * math.exp(-0.5), -0.4 * math.exp(-1)])
    assert got[15].ev_pead_age == 1.0
    assert all(r[c] is not None for r in got for c in r.asDict())
    assert events.event_features(spark.createDataFrame([], EVENTS)).collect() == []
