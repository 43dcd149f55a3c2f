"""Prefix scans, filters and latches against plain loops, over histories that many chunks hold."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.operators import recursions
from tidemark.streaming import events, stateful

DAY = datetime.date(1996, 1, 1)


def dated(spark, rows, schema):
    return spark.createDataFrame([(*r[:-1], *r[-1]) for r in rows], schema)


@pytest.fixture(scope="module")
def walks(spark):
    """Two symbols with nulls and gaps, one of 700 days and one of three, far apart."""
    rng = np.random.default_rng(1)
    rows = [(1, DAY + datetime.timedelta(int(d)), None if rng.random() < 0.1 else float(rng.normal())) for d in sorted(rng.choice(6000, 700, replace=False))]
    rows += [(2, DAY + datetime.timedelta(40_000 * k), float(k)) for k in range(3)]
    return rows, spark.createDataFrame(rows, "symbol long, date date, z double").repartition(5)


def by_symbol(rows):
    return {s: [r for r in rows if r[0] == s] for s in sorted({r[0] for r in rows})}


def test_sums_and_last_values_by_scan(walks):
    rows, df = walks
    out = scans.prefixes(df, "total", F.coalesce("z", F.lit(0.0)), scans.by(lambda a, b: a + b), ["symbol"], scans.day())
    out = scans.latest(out, "last", F.col("z"), ["symbol"], scans.day())
    got = {(r.symbol, r.date): (r.total, r.last) for r in out.collect()}
    assert len(got) == len(rows) and out.columns == ["symbol", "date", "z", "total", "last"]
    for part in by_symbol(rows).values():
        total, last = 0.0, None
        for s, d, z in part:
            total, last = total + (z or 0.0), last if z is None else z
            assert got[s, d] == (pytest.approx(total, abs=1e-9), last)


@pytest.mark.parametrize("crossing", [False, True])
def test_positions_against_a_loop(walks, crossing):
    rows, df = walks
    got = {(r.symbol, r.date): r.position for r in recursions.positions(df, "z", 1.0, 0.3, ["symbol"], crossing).collect()}
    for part in by_symbol(rows).values():
        state = 0
        for s, d, z in part:
            if z is not None:
                if state == 0:
                    state = -1 if z > 1 else 1 if z < -1 else 0
                elif crossing and (z > -0.3 if state == 1 else z < 0.3) or not crossing and abs(z) < 0.3:
                    state = 0
            assert got[s, d] == state


def test_selector_against_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 3, DAY + datetime.timedelta(k // 3), float(rng.normal(0, 0.1)), float(rng.normal(0, 0.1))) for k in range(900)]
    out = recursions.selector(spark.createDataFrame(rows, "sector long, date date, a double, b double"), "a", "b", "sector", n=6, margin=0.01, hold=4)
    got = {(r.sector, r.date): (r.chosen, r.switched) for r in out.collect()}
    changes = 0
    for part in by_symbol(rows).values():
        chosen, passed, a, b = "first", 0, [], []
        for s, d, x, y in part:
            a, b = (a + [x])[-6:], (b + [y])[-6:]
            ahead = np.mean(b) - np.mean(a)
            switch = ("second" if ahead > 0 else "first") != chosen and passed >= 4 and abs(ahead) > 0.01
            chosen, passed = (("second" if ahead > 0 else "first"), 0) if switch else (chosen, passed + 1)
            changes += switch
            assert got[s, d] == (chosen, switch)
    assert changes > 20


def plain_filter(x, y, delta, noise, first):
    n = min(len(x), first)
    i, h = np.linalg.lstsq(np.column_stack([np.ones(n), x[:n]]), y[:n], rcond=None)[0]
    state, cov = np.array([h, i]), np.eye(2)
    for a, b in zip(x, y):
        cov = cov + delta * np.eye(2)
        row = np.array([a, 1.0])
        gain = cov @ row / (row @ cov @ row + noise)
        state = state + gain * (b - row @ state)
        cov = cov - np.outer(gain, row @ cov)
        spread = b - row @ state
        yield *state, spread, spread / np.sqrt(abs(cov[0, 0]) * a * a + abs(cov[1, 1]) + noise)


def test_filter_and_trades_against_loops(spark):
    rng = np.random.default_rng(3)
    pairs, rows = {}, []
    for a, n, kind in ((1, 400, "moving"), (2, 150, "still"), (3, 1, "moving"), (4, 70, "constant")):
        x = 20 + np.cumsum(rng.normal(size=n)) if kind != "constant" else np.full(n, 7.0)
        y = x * (1.5 + (np.arange(n) / 200 if kind == "moving" else 0)) + 3 + rng.normal(size=n)
        pairs[a] = list(plain_filter(x, y, 1e-4, 1e-3, 100))
        rows += [(a, a + 10, DAY + datetime.timedelta(2 * k), float(u), float(v)) for k, (u, v) in enumerate(zip(x, y))]
    filtered = recursions.kalman(spark.createDataFrame(rows, "a long, b long, date date, x double, y double").repartition(3))
    got = filtered.orderBy("a", "date").collect()
    for a, want in pairs.items():
        mine = [(r.hedge, r.intercept, r.spread, r.z) for r in got if r.a == a]
        assert np.allclose(mine, want, rtol=1e-9, atol=1e-9), a
    trades = recursions.pair_trades(filtered, enter=0.05, leave=0.01, warm=30).orderBy("a", "date").collect()
    closed = 0
    for a, want in pairs.items():
        state, opened = 0, None
        for k, (r, (_, _, _, z)) in enumerate(zip([r for r in trades if r.a == a], want)):
            profit = None
            if k >= 30:
                if state == 0 and abs(z) > 0.05:
                    state, opened = (-1 if z > 0.05 else 1), z
                elif state and (z > -0.01 if state == 1 else z < 0.01):
                    profit, state, closed = state * (z - opened) * 1000, 0, closed + 1
            assert r.position == state and (r.profit is None) == (profit is None) and (profit is None or r.profit == pytest.approx(profit, abs=1e-6))
    assert closed > 5
    book = recursions.pair_book(recursions.pair_trades(filtered, 0.05, 0.01)).orderBy("date").collect()
    assert book[-1].total == pytest.approx(sum(b.ret for b in book)) and sum(b.closed for b in book) == closed


def test_too_many_states_are_refused():
    with pytest.raises(ValueError):
        scans.packed([F.lit(0)] * 20)


def test_latched_drawdowns_carry_over_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(k, datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=int(rng.integers(0, 400))), int(rng.integers(3)), None if rng.random() < 0.05 else float(rng.uniform(1, 10))) for k in range(300)]
    schema = "event_id long, ts timestamp, user_id long, value double"
    half = sorted(rows, key=lambda r: (r[1], r[0]))
    state = spark.createDataFrame([], stateful.PEAKS)
    got = {}
    for part in (half[:100], half[100:101], half[101:]):
        out = stateful.drawdown_step(spark.createDataFrame(part, schema), state, 0.6).collect()
        got |= {r.event_id: (r.peak, r.latched) for r in out}
        new = {u: (max((r.peak for r in out if r.user_id == u and r.peak is not None), default=None), any(r.latched for r in out if r.user_id == u)) for u in range(3)}
        old = {r.user_id: (r.peak, r.latched) for r in state.collect()}
        both = {u: (max([p for p, _ in (new[u], old.get(u, (None, False))) if p is not None], default=None), new[u][1] or old.get(u, (None, False))[1]) for u in range(3)}
        state = spark.createDataFrame([(u, *v) for u, v in both.items()], stateful.PEAKS)
    peak, latched = {}, {}
    for i, _, u, v in half:
        if v is not None:
            peak[u] = max(peak.get(u, v), v)
            latched[u] = latched.get(u, False) or v <= peak[u] * (1 - 0.6)
        assert got[i] == (peak.get(u), latched.get(u, False))


def test_late_rows_are_counted_and_corrected(spark, tmp_path):
    rng = np.random.default_rng(5)
    start = datetime.datetime(2020, 1, 1)
    batches = []
    for b in range(4):
        rows = [(1000 * b + k, start + datetime.timedelta(hours=int(24 * 3 * b + rng.integers(72))), int(rng.integers(4)), "view", float(rng.integers(100)), "{}") for k in range(60)]
        if b:  # some rows of the first days come again and again
            rows += [(1000 * b + 900 + k, start + datetime.timedelta(hours=int(rng.integers(20))), 1, "view", 1000.0 + b, "{}") for k in range(b)]
        batches.append(rows)
        spark.createDataFrame(rows, events.SCHEMA.replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = events.source(spark, f"{tmp_path}/in", "*.parquet", 1)
    marks = stateful.land(stream, f"{tmp_path}/out", "1 DAY").orderBy("batch").collect()
    newest, want = None, []
    for rows in batches:
        want.append(sum(newest is not None and r[1] < newest - datetime.timedelta(days=1) for r in rows))
        newest = max([r[1] for r in rows] + ([newest] if newest else []))
    assert [m.n_late for m in marks] == want and [m.n_rows for m in marks] == [len(b) for b in batches] and sum(want) >= 3
    landed = stateful.landed(events.SCHEMA.replace("timestamp_ntz", "timestamp"), spark, f"{tmp_path}/out")
    table = f"{tmp_path}/bars"
    stateful.publish(landed, table)
    everything = sorted(map(tuple, stateful.daily(landed).select("day", "user_id", "open", "high", "low", "close", "n").collect()))
    assert sorted(map(tuple, stateful.read_bars(spark, table).collect())) != everything
    stateful.correct(landed, table)
    assert sorted(map(tuple, stateful.read_bars(spark, table).collect())) == everything
