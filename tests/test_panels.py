"""Amounts, adjustments and signature slopes on rows whose results are worked out by hand or by loops."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from tidemark.operators import panels


def test_amount_middle_takes_ranges_and_single_amounts(spark):
    rows = spark.createDataFrame([("$1,001 - $15,000",), ("$500",), ("7-9",), ("none",), (None,), ("",)], "range string")
    assert [x.m for x in rows.select(panels.amount_middle("range").alias("m")).collect()] == [8000.5, 500.0, 8.0, None, None, None]


def test_drift_adjusts_only_near_and_large_surprises(spark):
    rows = spark.createDataFrame([(1, 0.9, 6.0, 1), (2, 0.4, -5.0, 60), (3, 0.4, 4.9, 5), (4, 0.4, 9.0, 0), (5, 0.4, 9.0, 61), (6, 0.4, None, None)], "symbol int, confidence double, surprise_pct double, days_since int")
    got = {x.symbol: (x.multiplier, round(x.confidence, 9)) for x in panels.drift_adjusted(rows).collect()}
    assert got == {1: (1.25, 1.0), 2: (0.85, 0.34), 3: (1.0, 0.4), 4: (1.0, 0.4), 5: (1.0, 0.4), 6: (1.0, 0.4)}


def test_signature_slope_against_a_loop(spark):
    closes = np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 90))) * 50
    day = datetime.date(2001, 1, 1)
    rows = spark.createDataFrame([(1, day + datetime.timedelta(i), float(x)) for i, x in enumerate(closes)], "symbol int, date date, close double")
    got = [x.slope for x in panels.signature_slope(rows).orderBy("date").collect()]
    want, slope = [], 0.0
    for i in range(90):
        if i >= 19 and (i - 19) % 5 == 0:
            window, points = closes[max(0, i - 59) : i + 1], []
            for step in (1, 2, 5, 10, 15):
                moves = np.diff(np.log(window[::step]))
                if len(moves) >= 2:
                    points.append((step, moves.std(ddof=1) * np.sqrt(252 / step)))
            slope = np.polyfit(*zip(*points), 1)[0]
        want.append(slope)
    assert got == pytest.approx(want, abs=1e-9)


def test_a_rank_takes_one_sort_and_counts_ties(spark):
    from tidemark.functions import frames as fr

    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 1.0), (1, None), (1, 3.0), (2, 0.0), (2, -0.0)], "date int, x double")
    out = rows.select("date", "x", fr.pct_rank("x").alias("r"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted((r.date, str(r.x), r.r) for r in out.collect()) == sorted([(1, "2.0", 2.5 / 4), (1, "2.0", 2.5 / 4), (1, "1.0", 0.25), (1, "None", None), (1, "3.0", 1.0), (2, "0.0", 0.75), (2, "-0.0", 0.75)], key=lambda r: r[:2])


def test_bars_are_dealt_once_over_partitions_that_grow_with_the_ticks(spark, sf_dir, monkeypatch):
    """A symbol's ticks meet in one partition, so bars and windows by symbol share the only shuffle; a task keeps a bounded share."""
    from tidemark.functions import frames as fr
    from tidemark.sources import market

    monkeypatch.setattr(market, "DEALT", 500)
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
    out = market.daily_bars(spark, sf_dir).withColumn("r", fr.change("close"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert out.rdd.getNumPartitions() == n
    assert market.by_date(spark, sf_dir)(out).rdd.getNumPartitions() == n


def test_path_shapes_join_nothing_and_sort_no_frame(spark):
    import datetime

    import numpy as np

    from tidemark.operators import shapes

    x = np.random.default_rng(5).normal(size=40)
    for w in (5, 21):
        got = shapes.last_quantile(x, (0.95, 0.05), w)
        assert all(np.allclose(got[q], [np.quantile(x[max(0, i - w + 1) : i + 1], q) for i in range(40)]) for q in got)
    rows = [(s, datetime.date(2020, 1, 1) + datetime.timedelta(k), 5.0 + s + (k * k) % 7) for s in (0, 1) for k in range(3)]
    plan = shapes.regime_path_shape(spark.createDataFrame(rows, "symbol long, date date, close double"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "percentile" not in plan


def test_frames_raise_no_powers_and_sort_once(spark):
    from tidemark.operators import features, micro

    rows = spark.createDataFrame([(1, 1, 2.0)], "symbol long, date int, close double")
    plan = lambda out: out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan(features.tail_probabilities(rows)).split("\n") if "Window [" in line]
    assert windows and not any("POWER" in line.upper() for line in windows)
    assert plan(micro.path_shape(rows)).count("percentile(") == 1
