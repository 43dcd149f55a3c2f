"""Pairs by tiles against plain loops: blocks that do not divide a cluster, constants, gaps and values that are no numbers."""

from __future__ import annotations

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.functions import frames as fr
from tidemark.operators import features, joins, pair_paths, pairs, recursions, signals, strategies
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(5)
    rows = {}
    for symbol in range(23):
        for day in range(60):
            if rng.random() < 0.6:
                value = 7.3 if symbol == 4 else 1e7 + rng.random() if symbol == 5 else float(rng.normal(100, 20))
                rows[symbol, day] = math.nan if (symbol, day) == (6, 30) else value
    return rows


def frame(spark, panel):
    start = dt.date(2024, 1, 1)
    rows = [(s, start + dt.timedelta(days=d), s % 2, v) for (s, d), v in panel.items()]
    return spark.createDataFrame([*rows, (1, None, 1, 2.0), (1, dt.date(2025, 1, 1), 1, None)], "symbol long, date date, cluster int, v double")


def met(panel, a, b):
    days = sorted(d for s, d in panel if s == a and (b, d) in panel)
    return np.array([panel[a, d] for d in days]), np.array([panel[b, d] for d in days])


def same(x, y):
    return (x is None and y is None) or (x is not None and y is not None and (math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) or math.isnan(x) and math.isnan(y)))


@pytest.mark.parametrize("size", [3, 5, 512])
def test_statistics_of_pairs(spark, panel, size):
    got = {(r["a"], r["b"]): r for r in pairs.statistics(frame(spark, panel), "cluster", "v", 20, size).collect()}
    want = 0
    for a, b in combinations(range(23), 2):
        x, y = met(panel, a, b)
        if a % 2 != b % 2 or len(x) < 20:
            assert (a, b) not in got
            continue
        want += 1
        r = got[a, b]
        dx, dy = x - x.mean(), y - y.mean()
        if a == 4:
            assert r["hedge"] is None and r["correlation"] is None
        elif b == 4:
            assert same(r["hedge"], 0.0) and r["correlation"] is None and r["residual_std"] == 0
        else:
            assert same(r["hedge"], dx @ dy / (dx @ dx)) and same(r["correlation"], dx @ dy / math.sqrt((dx @ dx) * (dy @ dy)))
            assert same(r["deviation"], y.std(ddof=1)) and r["n"] == len(x)
    assert want == len(got) > 50


def test_no_row_for_each_pair_and_date_is_shuffled(spark, panel):
    plan = pairs.statistics(frame(spark, panel), "cluster", "v", 20)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "date" not in plan.split("FlatMapGroupsInArrow")[0]


def test_no_rows(spark, panel):
    assert pairs.statistics(frame(spark, panel).where("symbol = 1"), "cluster", "v").isEmpty()


@pytest.mark.parametrize("size", [4, 512])
def test_concordance_of_pairs(spark, panel, size):
    got = {(r["a"], r["b"]): (r["n"], r["tau"]) for r in pairs.concordance(frame(spark, panel), "cluster", "v", size).collect()}
    want = {}
    for a, b in combinations(range(23), 2):
        x, y = met(panel, a, b)
        if a % 2 == b % 2 and len(x) > 1:
            s = np.sign(np.diff(x)) * np.sign(np.diff(y))
            want[a, b] = (len(s), s.mean())
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and same(got[k][1], float(want[k][1])) for k in want)


def rows_of(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def alike(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert all(same(x, y) or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7) if isinstance(y, float) or y is None else x == y for x, y in zip(a, b, strict=True)), (a, b)


def finite(spark, panel):
    """Without values that are no numbers and without the symbol whose spreads are rounding alone."""
    return frame(spark, {k: v for k, v in panel.items() if not math.isnan(v) and k[0] != 5}).where("date is not null and v is not null")


@pytest.mark.parametrize("size", [3, 512])
def test_filter_and_trades_by_tiles_against_the_scans(spark, panel, size):
    rows = finite(spark, panel)
    met = joins.pairs(rows, ["cluster", "date"], "v")
    scanned = recursions.kalman(met).drop("x", "y").cache()
    alike(rows_of(pair_paths.kalman(rows, "cluster", "v", size=size), "a", "b", "date"), rows_of(scanned, "a", "b", "date"))
    traded = recursions.pair_trades(scanned, 0.5, 0.1, 5).select("a", "b", "date", "position", "z", "profit").cache()
    got = pair_paths.trades(rows, "cluster", "v", 0.5, 0.1, 5, size=size)
    assert traded.where("profit is not null").count() > 50
    alike(rows_of(got, "a", "b", "date"), rows_of(traded, "a", "b", "date"))
    book = recursions.booked(pair_paths.daily_trades(rows, "cluster", "v", 0.5, 0.1, 5, size=size))
    alike(rows_of(book, "date"), rows_of(recursions.pair_book(traded), "date"))
    last = recursions.signalled(pair_paths.last_filtered(rows, "cluster", "v", size))
    alike(rows_of(last, "a", "b"), rows_of(recursions.latest_pair_signals(recursions.pair_trades(scanned)), "a", "b"))


@pytest.mark.parametrize("size", [3, 512])
def test_frames_of_common_dates_by_tiles_against_windows(spark, panel, size):
    # a constant has no slope: all of its z are null, while the windows divide by what rounding leaves
    assert pair_paths.spread_z(finite(spark, panel), "cluster", "v", 8, 18, size).where("a = 4").select(F.count("*") > 20, F.count("z")).first() == (True, 0)
    rows = finite(spark, panel).where("symbol <> 4")
    met = joins.pairs(rows, ["cluster", "date"], "v").cache()
    z = signals.spread_z(met, signals.pair_statistics(met, 18), 8).cache()
    assert z.where("z is not null").count() > 500
    alike(rows_of(pair_paths.spread_z(rows, "cluster", "v", 8, 18, size), "a", "b", "date"), rows_of(z, "a", "b", "date"))
    held = strategies.pair_positions(z, 1.0, 0.3).cache()
    assert held.where("position <> 0").count() > 100
    alike(rows_of(pair_paths.positions(rows, "cluster", "v", 1.0, 0.3, 8, 18, size), "a", "b", "date"), rows_of(held, "a", "b", "date"))
    w = fr.Window.partitionBy("a", "b").orderBy("date")
    moves = met.select("a", "b", "date", (fr.div("y", F.lag("y").over(w)) - fr.div("x", F.lag("x").over(w))).alias("spread_return"))
    alike(rows_of(pair_paths.daily_profit(rows, "cluster", "v", 1.0, 0.3, 8, 18, size), "date"), rows_of(strategies.pair_returns(held, moves), "date"))
    alike(rows_of(pair_paths.correlation_change(rows, "cluster", "v", 4, 12, size), "a", "b", "date"), rows_of(features.correlation_change(met, 4, 12), "a", "b", "date"))
    some = rows.withColumn("v", F.when(F.dayofmonth("date") % 3 == 0, F.col("v")))
    alike(rows_of(pair_paths.confirmation(some, "cluster", "v", size), "a", "b", "date"), rows_of(strategies.confirmation(met.select("a", "b", "date"), some, "v"), "a", "b", "date"))


@pytest.mark.parametrize("name", ["G14_kalman_hedge", "G34_kalman_trades", "G34_pair_book", "G34_latest_signals", "G11_spread_z", "G12_pair_positions", "G12_pair_profit", "G13_pair_confirmation", "W33_correlation_change"])
def test_pairs_meet_in_tiles_and_never_as_shuffled_rows(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("FlatMapGroupsInArrow")[0]
    assert plan.count("FlatMapGroupsInArrow") == 1 and "hashpartitioning(a" not in above and "SortMergeJoin" not in above


def test_tiles_read_blocks_that_are_stored_once(spark, panel):
    """Histories are not shuffled to each tile, and a task has few tiles however small their rows are."""
    found = pairs.tiles(frame(spark, panel), "cluster", "v", 3)
    rows = found.collect()
    assert found.columns == ["cluster", "i", "j", "left", "right"] and found.rdd.getNumPartitions() == len(rows) == 20
    blocks = {r.left for r in rows} | {r.right for r in rows}
    assert len(blocks) == 8 and sorted((r.cluster, r.i, r.j) for r in rows) == [(c, i, j) for c in range(2) for i in range(4) for j in range(i, 4)]
    stored = [r.symbol for b in blocks for r in spark.read.parquet(b).collect()]
    assert sorted(stored) == list(range(23))
    plan = pairs.statistics(frame(spark, panel), "cluster", "v", 20, 3)._jdf.queryExecution().executedPlan().toString()
    assert "values" not in plan and "array" not in plan


def test_pairs_are_never_broadcast(spark, sf_dir):
    """V42_correlation_regime: a tile's row is small, its pairs are not."""
    plan = catalog.queries()["V42_correlation_regime"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan.split("FlatMapGroupsInArrow")[0]
