"""State clusters on planted states, macro columns and filings on hand-made rows."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import frames
from tidemark.operators import regimes, text

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    rows, state = [], 0
    for k in range(1200):
        state = state if rng.random() < 0.95 else int(rng.integers(3))
        x = rng.multivariate_normal([(0, 0), (4, 1), (9, -3)][state], [[0.3, 0.1], [0.1, 0.4]])
        rows.append((k % 2, DAY + datetime.timedelta(k // 2), state, float(x[0]), float(x[1]) if k % 50 else None, [0.02, 0.0, -0.03][state]))
    return spark.createDataFrame(rows, "symbol long, date date, truth int, x double, y double, ret double")


def test_planted_states_are_found_on_any_partitioning(planted):
    got = regimes.mixture(planted, ["x", "y"], 3).collect()
    assert len(got) == planted.where("y is not null").count() and np.mean([r.state == r.truth for r in got]) > 0.99
    again = regimes.mixture(planted.repartition(7), ["x", "y"], 3).collect()
    assert {(r.symbol, r.date, r.state) for r in got} == {(r.symbol, r.date, r.state) for r in again}
    assert {r.state for r in regimes.mixture(planted.withColumn("x", F.lit(1.0)), ["x", "y"], 3).collect()} == {0}
    assert regimes.mixture(planted.where("false"), ["x", "y"], 3).collect() == []


def test_labels_and_moves_of_states(spark, planted):
    rows = planted.withColumn("state", F.col("truth"))
    label = {r.state: r.regime for r in regimes.labelled(rows).collect()}
    assert label == {0: "bull", 1: None, 2: "bear"}
    moves = {(r.before, r.after): (r.n, r.share) for r in regimes.moves(rows, 4).collect()}
    path = {s: [r.truth for r in planted.where(F.col("symbol") == s).orderBy("date").collect()] for s in (0, 1)}
    for a in range(4):
        total = sum(p[:-1].count(a) for p in path.values())
        for b in range(4):
            n = sum(x == a and y == b for p in path.values() for x, y in zip(p, p[1:]))
            assert moves[a, b] == (n, pytest.approx(n / total if total else 0))


def test_macro_levels_are_carried_from_their_release(spark):
    days = [DAY + datetime.timedelta(k) for k in (0, 3, 5, 9)]
    rows = spark.createDataFrame([(1, d) for d in days] + [(2, days[1])], "symbol long, date date")
    releases = spark.createDataFrame([(days[1], 10.0), (DAY + datetime.timedelta(7), 15.0)], "date date, level double")
    got = {(r.symbol, r.date): (r.macro_level, r.macro_change, r.macro_age) for r in regimes.with_macro(rows, releases).collect()}
    assert got == {(1, days[0]): (None, None, None), (1, days[1]): (10.0, None, 0), (2, days[1]): (10.0, None, 0), (1, days[2]): (10.0, None, 2), (1, days[3]): (15.0, 0.5, 2)}


def test_filings_with_missing_parts_and_malformed_documents(spark):
    one = "<nonDerivativeTransaction><transactionCoding><transactionCode>{}</transactionCode></transactionCoding><transactionAmounts>{}</transactionAmounts></nonDerivativeTransaction>"
    shares, price = "<transactionShares><value>{}</value></transactionShares>", "<transactionPricePerShare><value>{}</value></transactionPricePerShare>"
    whole = "<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>A &amp; B</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable>{}</nonDerivativeTable></ownershipDocument>"
    rows = [
        (1, whole.format(one.format("P", shares.format(3) + price.format("2.5")) + one.format("S", shares.format(4)))),
        (2, whole.format(one.format("M", price.format("x") + shares.format(1))).replace("<rptOwnerName>A &amp; B</rptOwnerName>", "")),
        (3, whole.format(one.format("P", shares.format(3)))[:150]), (4, "no xml at all"), (5, whole.format("")), (6, "<ownershipDocument></ownershipDocument>"),
    ]
    got = regimes.filings(spark.createDataFrame([(i, DAY, x) for i, x in rows], "id long, filed date, xml string")).orderBy("id", "kind").collect()
    assert [(r.id, r.malformed, r.owner, r.kind, r.shares, r.price, r.value) for r in got] == [
        (1, False, "A & B", "buy", 3.0, 2.5, 7.5), (1, False, "A & B", "sell", 4.0, 0.0, 0.0), (2, False, "Unknown", "buy", 1.0, 0.0, 0.0),
        (3, True, None, None, None, None, None), (4, True, None, None, None, None, None),
    ]


def test_lexicon_against_a_loop(spark):
    good, bad, no = sorted(text.BULLISH)[0], sorted(text.BEARISH)[0], sorted(text.NEGATIONS)[0]
    texts = [f"{good} {good} {bad}", f"{no} x {good} y {bad} {bad}", f"{no} {no} {good}", "zzz", "", None, f"{bad.upper()}, {good}!"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in texts], "t string").select(text.lexicon_score(F.col("t")).alias("s")).collect()]
    for x, s in zip(texts, got, strict=True):
        up = down = flip = 0
        for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split():
            sign = ((w in text.BULLISH) - (w in text.BEARISH)) * (-1 if flip > 0 else 1)
            up, down, flip = up + (sign > 0), down + (sign < 0), 3 if w in text.NEGATIONS else max(flip - 1, 0)
        assert (s is None and x is None) or s == pytest.approx((up - down) / (1 + up + down)), x


def test_a_round_shuffles_nothing_and_reads_blocks(spark, planted, monkeypatch):
    """Rounds read stored blocks of rows as matrices; the densities are those of the plain formula."""
    sizes, read = [], type(spark.read).parquet

    def parquet(self, path):
        out = read(self, path)
        sizes.append(out.count() if "mixture-blocks" in path else None)
        return out

    monkeypatch.setattr(type(spark.read), "parquet", parquet)
    rows = planted.where("y is not null")
    got = regimes.mixture(rows.coalesce(1), ["x", "y"], 3)
    assert [n for n in sizes if n is not None] == [1] and got.count() == rows.count()
    rng = np.random.default_rng(3)
    x, mean, half = rng.normal(size=(50, 2)), rng.normal(size=(3, 2)), rng.normal(size=(3, 2, 2))
    cov, weight = half @ half.transpose(0, 2, 1) + 0.1 * np.eye(2), np.array([0.2, 0.3, 0.5])
    plain = [[np.log(w) - 0.5 * (v - m) @ np.linalg.inv(c) @ (v - m) - 0.5 * np.log(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(weight, mean, cov)] for v in x]
    assert np.allclose(regimes._terms(x) @ regimes._log_density(weight, mean, cov), plain)


def test_quantiles_from_counts_of_bits_are_exact(spark):
    """No task gathers the values: 0.25 and 0.75 of blocks with negative, equal, huge and tiny values, in several files."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 1001):
        x = np.round(rng.normal(size=n), 2) * 10.0 ** rng.integers(-200, 200, n)
        stored = spark.createDataFrame([(bytearray(np.stack([part, part]).tobytes()),) for part in np.array_split(x, 3) if len(part)], "x binary").repartition(2)
        assert regimes._quantiles(stored, 2, n, [0.0, 0.25, 0.5, 0.75, 1.0]) == pytest.approx(np.quantile(x, [0.0, 0.25, 0.5, 0.75, 1.0]), rel=1e-12)


def test_blocks_do_not_depend_on_the_size_of_batches(spark, planted, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    former, sizes, read = spark.conf.get(key), [], type(spark.read).parquet

    def parquet(self, path):
        out = read(self, path)
        sizes.append(out.count() if "mixture-blocks" in path else None)
        return out

    monkeypatch.setattr(type(spark.read), "parquet", parquet)
    rows = planted.where("y is not null").coalesce(1)
    want = {(r.symbol, r.date, r.state) for r in regimes.mixture(rows, ["x", "y"], 3).collect()}
    try:
        spark.conf.set(key, 100)
        monkeypatch.setattr(regimes, "BLOCK", 500)
        got = regimes.mixture(rows, ["x", "y"], 3)
        assert [n for n in sizes if n is not None] == [1, 3] and {(r.symbol, r.date, r.state) for r in got.collect()} == want
    finally:
        spark.conf.set(key, former)


def test_features_are_those_of_windows(spark):
    rng, day = np.random.default_rng(6), F.date_add(F.lit(DAY), F.col("k"))
    close = [(s, k, float(v) if k % 90 else 0.0) for s in range(2) for k, v in enumerate(np.exp(rng.normal(size=300)))]
    bars = spark.createDataFrame(close, "symbol long, k int, close double").withColumn("date", day)
    ret = frames.change("close")
    want = bars.withColumn("ret", ret).withColumns({"volatility": frames.rolling("std", "ret", 20), "momentum_20": frames.change("close", 20), "momentum_60": frames.change("close", 60), "drawdown": frames.div("close", F.max("close").over(frames.last_rows(252))) - 1})
    names = ["ret", "volatility", "momentum_20", "momentum_60", "drawdown"]
    for a, b in zip(regimes.features(bars).orderBy("symbol", "date").collect(), want.orderBy("symbol", "date").collect(), strict=True):
        assert [a[c] is None for c in names] == [b[c] is None for c in names] and [a[c] or 0 for c in names] == pytest.approx([b[c] or 0 for c in names], rel=1e-9)
