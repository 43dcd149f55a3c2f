"""Closed-form cases and properties: recursive averages, ranks, past-only features, determinism."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import frames as fr
from tidemark.operators import portfolio, reports, technical
from tidemark.sources import market, store


def bars_of(spark, closes: list[float], symbol: int = 1):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(symbol, day + dt.timedelta(days=k), c, c + 1, c - 1, c, 10.0) for k, c in enumerate(closes)], "symbol long, date date, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("span", [2, 5, 12, 26])
def test_recursive_average_over_many_chunks(spark, span):
    values = [((k * 37) % 101) / 7 + 1 for k in range(700)]
    got = [r["e"] for r in fr.ema(bars_of(spark, values), {"e": ("close", span)}).orderBy("date").select("e").collect()]
    a, want = 2 / (span + 1), values[0]
    for k, x in enumerate(values):
        want = x if k == 0 else (1 - a) * want + a * x
        assert got[k] == pytest.approx(want, rel=1e-10)


def test_rank_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None)], "date int, x double")
    got = sorted((r["x"], r["p"]) for r in rows.select("x", fr.pct_rank("x").alias("p")).collect() if r["x"] is not None)
    assert got == [(1.0, pytest.approx(1 / 3)), (2.0, pytest.approx(2.5 / 3)), (2.0, pytest.approx(2.5 / 3))]


def test_norm_cdf(spark):
    row = spark.range(1).select(*(fr.norm_cdf(F.lit(x)).alias(n) for n, x in (("a", 0.0), ("b", 1.959963985), ("c", -1.959963985)))).first()
    assert row["a"] == pytest.approx(0.5, abs=1e-6) and row["b"] == pytest.approx(0.975, abs=1e-6) and row["c"] == pytest.approx(0.025, abs=1e-6)


@pytest.mark.parametrize("build", [technical.price_features, technical.regime_features, technical.momentum_quality, technical.rsi, technical.macd, technical.adx])
def test_features_only_see_the_past(spark, sf_dir, build):
    bars = market.daily_bars(spark, sf_dir).where("symbol <= 2")
    cut = F.lit("1998-06-01").cast("date")
    changed = bars.withColumns({c: F.when(F.col("date") >= cut, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})
    before = lambda df: sorted(map(str, build(df).where(F.col("date") < cut).drop("open", "high", "low", "close").collect()))
    assert before(bars) == before(changed)


def test_tail_has_no_label(spark):
    rows = technical.forward_label(bars_of(spark, [float(k + 1) for k in range(40)]), horizon=5, warm_up=20).collect()
    assert len(rows) == 15 and all(r["label"] == 1 for r in rows)


def test_one_holding_period_is_ten_percent(spark):
    rows = spark.createDataFrame([("s", dt.date(2020, 1, k + 1), r) for k, r in enumerate([0.1, 0.0, 0.0])], "strategy string, date date, ret double")
    got = portfolio.performance(rows, "strategy").first()
    assert got["total_return"] == pytest.approx(0.1) and got["max_drawdown"] == 0


def test_permutation_test_is_deterministic_and_small_for_a_strong_mean(spark):
    rows = spark.createDataFrame([("good", dt.date(2020, 1, 1) + dt.timedelta(days=k), 0.01) for k in range(60)] + [("flat", dt.date(2020, 1, 1) + dt.timedelta(days=k), 0.01 * (-1) ** k) for k in range(60)], "s string, date date, ret double")
    a, b = ({r["s"]: r["p_value"] for r in portfolio.permutation_test(rows, "s", 99).collect()} for _ in range(2))
    assert a == b and a["good"] == pytest.approx(0.01) and a["flat"] > 0.2


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(days=k), 0.01 + 0.001 * (k % 5)) for k in range(100)], "s string, date date, ret double")
    got = portfolio.bootstrap(rows, "s").first()
    assert got["low"] < 0.012 < got["high"]


def test_constant_prices_have_no_nan(spark):
    for build in (technical.regime_features, technical.price_features, technical.momentum_quality, technical.bollinger, technical.stochastic):
        for row in build(bars_of(spark, [5.0] * 80)).collect():
            assert not any(isinstance(x, float) and x != x for x in row)


def test_empty_bars(spark):
    for build in (technical.rsi, technical.adx, technical.price_features, technical.drawdown_periods):
        rows = bars_of(spark, [1.0]).where("false").withColumn("drawdown", F.lit(0.0))
        assert build(rows).count() == 0


def test_windows_are_whole_and_drawn_over_the_whole_calendar(spark):
    rows = market.with_returns(bars_of(spark, [float(k % 7 + 1) for k in range(700)]))
    starts = sorted(r["start"] for r in reports.window_starts(rows, 40, 100, 7).collect())
    assert len(set(starts)) == 40 and starts[0] >= 0 and 550 < starts[-1] <= 600
    assert starts != sorted(r["start"] for r in reports.window_starts(rows, 40, 100, 8).collect())
    assert sorted(r["start"] for r in reports.random_windows(rows, reports.window_starts(rows, 40, 100, 7), 100).collect()) == starts
    assert reports.window_starts(rows, 9999, 100, 7).count() == 601
    # Of fixed starts, those whose window the calendar does not hold are left out.
    assert sorted(r["start"] for r in reports.random_windows(rows, [10, 600, 601], 100).collect()) == [10, 600]
    assert reports.window_starts(rows.limit(100), 3, 100, 7).count() == 0


def test_articles_with_one_opening_are_told_apart(spark):
    opening, day = "Daily report of the exchange. " * 4, dt.date(2020, 1, 1)
    rows = spark.createDataFrame([(2, opening + "a", "S", day), (1, f" \n{opening}A\t", "s", day), (3, opening + "b", "S", day), (5, opening + "a", "S", day + dt.timedelta(days=1)), (7, opening + "a", "t", day), (9, None, None, None)], "id long, title string, source string, date date")
    keyed = rows.select("id", store.article_key("title", "source", "date").alias("key"))
    assert sorted(r["id"] for r in store.insert_new(keyed.where("id % 2 = 0"), keyed.where("id % 2 = 1"), "key").collect()) == [3, 5, 7, 9]


def test_headlines_are_whole(spark, sf_dir):
    longest = market.headlines(spark, sf_dir).agg(F.max(F.length("title"))).first()[0]
    assert longest == spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.max(F.length("text"))).first()[0] > 80


def test_recursive_averages_keep_their_state_over_nulls(spark):
    values = [None, 10.0, None, 10.0, 4.0, None, None, 7.0] + [float(k % 5) if k % 3 else None for k in range(150)]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "symbol int, date int, x double")
    got = [r["y"] for r in fr.ema(df, {"y": ("x", 3)}).orderBy("date").collect()]
    state, want = None, []
    for v in values:
        state = state if v is None else v if state is None else 0.5 * state + 0.5 * v
        want.append(state)
    assert got[0] is None and all(abs(a - b) < 1e-9 for a, b in zip(got[1:], want[1:]))


def test_running_sums_give_the_frames_moments(spark):
    import random

    rnd = random.Random(0)
    rows = [(s, d, None if rnd.random() < 0.1 else 3.0 if s == 2 else rnd.gauss(50, 2)) for s in (1, 2, 3) for d in range(90)]
    df = spark.createDataFrame(rows, "symbol int, date int, x double").withColumn("y", fr.lag("x"))
    w = fr.last_rows(20)
    kinds = {"mean": fr.rolling("mean", "x", 20, 5), "std": fr.rolling("std", "x", 20, 5), "sum": fr.rolling("sum", "x", 20, 5), "skew": F.when(F.count("x").over(w) >= 5, fr.corrected_skew("x", w)), "kurt": F.when(F.count("x").over(w) >= 5, fr.corrected_kurtosis("x", w))}
    out = fr.moments(df, "x", {k: (k, 20, 5) for k in kinds})
    out = fr.rolling_max(fr.rolling_correlation(out, "corr", "x", "y", 20), "most", "x", 20)
    kinds |= {"corr": fr.correlation("x", "y", w), "most": F.max("x").over(w)}
    for r in out.withColumns({f"{k}_want": c for k, c in kinds.items()}).collect():
        for k in kinds:
            a, b = r[k], r[f"{k}_want"]
            assert (a is None and b is None) or abs(a - b) < 1e-6 * max(1, abs(b)), (k, r)
