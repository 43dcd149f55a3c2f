"""Factors, clusters, calibration and the two-target model against linear algebra, plain loops and planted structure."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, factors

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def planted(spark):
    """Forty symbols that follow one of five series each, with a fifth of the days missing."""
    rng = np.random.default_rng(0)
    group = np.arange(40) % 5
    x = rng.normal(size=(5, 120))[group] + 0.3 * rng.normal(size=(40, 120))
    there = rng.random((40, 120)) > 0.2
    rows = [(s, DAY + datetime.timedelta(d), float(x[s, d])) for s in range(40) for d in range(120) if there[s, d]]
    return group, x, there, spark.createDataFrame(rows + [(3, DAY, None)], "symbol long, date date, ret double").where("not (symbol = 3 and date = '2020-01-01' and ret is not null)")


def test_planted_clusters_on_any_partitioning(spark, planted):
    group, _, _, df = planted
    labels = [{r.symbol: r.peer_cluster for r in factors.peer_clusters(x, "ret", 5).collect()} for x in (df, df.repartition(7), df.repartition(2, "date"))]
    assert labels[0] == labels[1] == labels[2]
    assert [labels[0][s] for s in range(40)] == group.tolist()  # named by their smallest symbols
    assert factors.peer_clusters(df.where("symbol < 3"), "ret").select("peer_cluster").distinct().collect() == [(0,)]
    assert factors.peer_clusters(df.where("false"), "ret").collect() == []
    assert factors.peer_clusters(df, "ret").select("peer_cluster").distinct().count() == 7  # the root of 40, rounded up


def test_residuals_against_singular_vectors(planted):
    _, x, there, df = planted
    there = there.copy()
    there[3, 0] = False
    z = np.zeros(x.shape)
    for s in range(40):
        v = x[s][there[s]]
        z[s][there[s]] = (v - v.mean()) / v.std(ddof=1)
    v = np.linalg.svd(z)[2][:5].T
    left = z - z @ v @ v.T
    got = factors.residuals(df, "ret", 5).collect()
    assert len(got) == there.sum()
    for r in got:
        assert r.residual == pytest.approx(left[r.symbol, (r.date - DAY).days], abs=1e-3)
    assert np.std([r.residual for r in got]) < 0.45  # the planted factors are gone
    assert {r.signal for r in got} <= {-1, 0, 1} and all((r.signal == -1) == (r.z > 2) for r in got)


def test_factors_read_the_panel_once_and_are_exact(spark):
    """No gap between the values that vectors hold: rounds of iteration would not settle."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 150))
    rows = [(s, DAY + datetime.timedelta(d), float(x[s, d])) for s in range(60) for d in range(150)]
    panel = factors.series(spark.createDataFrame(rows, "symbol long, date date, ret double").repartition(5), "ret")
    panel.write.format("noop").mode("overwrite").save()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for centred in (False, True):
        calendar, mean, got = factors.factors(panel, 5, centred)
        want = np.linalg.svd(x - x.mean(0) * centred)[2][:5].T
        assert len(calendar) == 150 and np.allclose(np.abs((got * want).sum(0)), 1, rtol=0, atol=1e-9) and np.allclose(mean, x.mean(0) * centred)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 30
    assert factors.factors(panel.limit(3), 5, False)[2].shape == (150, 3) and factors.factors(panel.where("false"), 5, True)[2].shape == (0, 0)


def plain_isotonic(score, label):
    blocks = []
    for s in sorted(set(score)):
        blocks.append([s, s, sum(y for x, y in zip(score, label) if x == s), score.count(s)])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            a, b = blocks.pop(-2), blocks.pop(-1)
            blocks.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    return [(a, b, t / n, n) for a, b, t, n in blocks]


@pytest.mark.parametrize("slope", [1.0, 0.0, -1.0])
def test_isotonic_against_a_pooling_loop(spark, slope):
    rng = np.random.default_rng(6)
    score = [round(float(x), 3) for x in rng.random(800)]
    label = [int(rng.random() < 0.5 + slope * (s - 0.5)) for s in score]
    rows = spark.createDataFrame(list(zip(score, label)) + [(None, 1), (0.5, None)], "s double, y int")
    got = calibration.isotonic(rows.repartition(6), "s", "y").orderBy("low").collect()
    assert [tuple(b) for b in got] == [pytest.approx(b) for b in plain_isotonic(score, label)]
    at = calibration.calibrated(spark.createDataFrame([(-1.0,), (0.33,), (2.0,), (None,)], "s double"), "s", calibration.isotonic(rows, "s", "y"), "p").collect()
    assert at[0].p == got[0].value and at[2].p == got[-1].value and at[3].p is None and got[0].value <= at[1].p <= got[-1].value
    none = calibration.isotonic(rows.where("false"), "s", "y")
    assert none.count() == 0 and calibration.calibrated(rows.limit(1), "s", none, "p").first().p == rows.first().s


def test_dates_are_split_with_a_purge(spark):
    rows = spark.range(500).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date"))
    part = [r.part for r in calibration.split_dates(rows, purge=5).orderBy("date").collect()]
    assert part == ["fit"] * 420 + ["purged"] * 5 + ["calibrate"] * 75
    part = [r.part for r in calibration.split_dates(rows.limit(40), purge=5).orderBy("date").collect()]
    assert part.count("calibrate") == 6 and part.count("purged") == 5


def test_two_targets_find_a_planted_effect(spark):
    rng = np.random.default_rng(7)
    rows = []
    for d in range(300):
        for s in range(8):
            x = float(rng.normal())
            move = 0.02 * x + 0.01 * float(rng.normal())
            rows.append((s, DAY + datetime.timedelta(d), x, None if rng.random() < 0.05 else float(rng.normal()), int(move > 0), move))
    df = spark.createDataFrame(rows, "symbol long, date date, x double, noise double, target int, forward_return double")
    cut = DAY + datetime.timedelta(240)
    out = calibration.dual_target(df.where(F.col("date") < cut), ["x", "noise"], df.where(F.col("date") >= cut), rounds=4).toPandas()
    assert len(out) == 480 and (out.y_pred == out.y_true).mean() > 0.8
    assert ((out.portfolio_score == calibration.VETO) == (out.y_proba < 0.52)).all() and 0 < out.vetoed.mean() < 1
    assert out.y_proba.between(0, 1).all() and out[["predicted_return", "forward_return"]].corr().iloc[0, 1] > 0.7


def test_trees_are_fitted_on_tasks_of_bounded_size(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "fit"))
    stored = spark.read.parquet(str(tmp_path / "fit"))
    dealt = calibration.spread(stored, 50)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) <= 55
    assert calibration.spread(stored, 1000).rdd.getNumPartitions() == stored.rdd.getNumPartitions()
