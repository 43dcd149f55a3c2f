"""Values that are equal but for rounding must not decide a result."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import frames
from tidemark.operators import features, reports
from tidemark.plans import catalog


def test_constant_skew_has_no_excess(spark):
    rows = spark.range(40).select(F.lit(1).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit(1.0).alias("pc_ratio"), F.lit(0.1).alias("iv_skew"), F.lit(0.0).alias("volume_z"))
    assert {r["signal"] for r in features.options_signal(rows).collect()} == {0}


def test_equal_scores_go_to_the_first_provider(spark):
    score = lambda f, c, l, r: 0.3 * f + 0.3 * c + 0.2 * (1 - min(l / 1000.0, 1.0)) + 0.2 * r
    found = {}
    for k in range(3000):
        parts = (1.0 / (1 + k % 5), k % 10 / 10.0, float(k % 1500), k % 4 / 4.0)
        found.setdefault(round(score(*parts), 9), {})[score(*parts)] = parts
    ties = [(v[min(v)], v[max(v)]) for v in found.values() if len(v) > 1]
    assert ties
    rows = [(i, name, *parts) for i, (low, high) in enumerate(ties) for name, parts in (("a", low), ("b", high))]
    out = reports.provider_choice(spark.createDataFrame(rows, "key long, provider string, freshness double, completeness double, latency_ms double, reliability double"))
    assert {r["provider"] for r in out.collect()} == {"a"}


def test_shares_on_a_half_round_as_in_the_sql(spark):
    """R3_event_panel: on a date with 1,280 rows the percentile 82 / 1280 ends with a 5 after the sixth digit."""
    x = [k / 1280 for k in range(1, 1281)] + [k / 12800 for k in range(1, 12801)] + [-41 / 640, 1e-9, 1e300, 1e305, math.inf, -math.inf]
    for digits in (6, 8):
        got = [r.x for r in frames.rounded(spark.createDataFrame(list(enumerate(x)), "k long, x double").coalesce(1), "k", digits=digits).orderBy("k").collect()]
        con = duckdb.connect()
        con.register("t", pa.table({"k": range(len(x)), "x": x}))
        assert got == [r[0] for r in con.execute(f"SELECT round(x, {digits}) FROM t ORDER BY k").fetchall()]


def test_a_change_of_one_deviation_is_on_the_same_side_as_in_the_sql(spark, tmp_path):
    """R30_social_signal: sentiments 1, 1, x, 1 change by 0, x - 1, 1 - x, whose last z is 1 but for rounding."""
    rows = [(4 * u + day, f"2024-01-0{day + 1} 10:00:00", u, 100.0 if day != 2 else u / 4, '{"k": %d}' % (90 if day == 3 else 1 + (u + day) % 5)) for u in range(400) for day in range(4)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double, props string").select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", F.lit("click").alias("event_type"), "value", "props")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.symbol, r.date): (r.sentiment_z, r.volume_z, r.signal) for r in catalog.queries()["R30_social_signal"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = {(r["symbol"], r["date"]): (r["sentiment_z"], r["volume_z"], r["signal"]) for r in con.execute(catalog.oracles()["R30_social_signal"]).to_arrow_table().to_pylist()}
    assert got == want and len(got) == 1600


def test_deviation_by_steps_is_the_deviation(spark):
    x = np.random.default_rng(1).normal(5, 2, 60)
    rows = [("a", k, float(v) if k % 7 else None) for k, v in enumerate(x)] + [("b", k, 0.1) for k in range(9)]
    out = spark.createDataFrame(rows, "symbol string, date int, x double").select("symbol", frames.stepped_std("x", 5, 3).alias("got"), frames.rolling("std", "x", 5, 3).alias("want")).collect()
    assert all((r.got is None) == (r.want is None) and (r.got is None or math.isclose(r.got, r.want, rel_tol=1e-12, abs_tol=1e-15)) for r in out)
    assert {r.got for r in out if r.symbol == "b"} == {None, 0.0}
