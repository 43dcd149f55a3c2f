"""Steps over a key's rows as arrays against windows over the same frames."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as ar
from tidemark.functions import frames as fr
from tidemark.operators import states
from tidemark.plans import catalog

DAY = datetime.date(2020, 1, 1)


def panel(spark, seed=3, n=90):
    rng = np.random.default_rng(seed)
    rows = [(s, DAY + datetime.timedelta(int(k)), None if rng.random() < 0.1 else float(rng.normal() if s else 0.1)) for s in range(3) for k in rng.permutation(n)]
    return spark.createDataFrame([*rows, (9, DAY, None), (10, DAY, 1.5)], "symbol long, date date, x double")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_as_arrays_are_those_of_windows(spark):
    df = panel(spark)

    def step(x):
        v = x["x"]
        x |= {"a_mean": ar.mean(v, 20, 5), "a_std": ar.std(v, 20, 5), "a_z": ar.zscore(v, 20), "a_q": ar.quantile(v, 0.9, 20, 5), "a_lag": ar.lag(v, 3), "a_ema": ar.ema(v, 8)}

    got = ar.along(df, ["x"], ["a_mean", "a_std", "a_z", "a_q", "a_lag", "a_ema"], step)
    q = F.when(F.count("x").over(fr.last_rows(20)) >= 5, F.percentile("x", F.lit(0.9)).over(fr.last_rows(20)))
    want = fr.ema(df.withColumns({"a_mean": fr.rolling("mean", "x", 20, 5), "a_std": fr.rolling("std", "x", 20, 5), "a_z": fr.zscore("x", 20), "a_q": q, "a_lag": fr.lag("x", 3)}), {"a_ema": ("x", 8)})
    order = lambda f: sorted((tuple(r) for r in f.select(*got.columns).collect()), key=lambda r: r[:2])
    for a, b in zip(order(got), order(want), strict=True):
        assert a[:2] == b[:2] and [v is None for v in a] == [v is None for v in b]
        assert [v for v in a[2:] if v is not None] == pytest.approx([v for v in b[2:] if v is not None], abs=1e-12)


def test_states_look_back_without_frames_that_are_gone_through_for_every_row(spark):
    df = panel(spark).withColumnRenamed("x", "ret")
    for made in (states.symbol_states(states.with_market(df)), states.single_symbol_states(df)):
        assert "RowFrame, -62" not in plan(made) and "RowFrame, -20" not in plan(made)


#: What the plan of a query held before its frames became steps over arrays.
GONE = {
    "W15_all_interactions": "RowFrame, -199",
    "W21_residual_stability": "RowFrame, -62",
    "M34_signature_slope": "collect_list",
    "W14_momentum_quality": "RowFrame, -62",
    "M6_illiquidity": "RowFrame, -99",
    "R5_dependence": "collect_list",
}


@pytest.mark.parametrize("name", GONE)
def test_long_frames_are_steps_over_arrays(spark, sf_dir, name):
    assert GONE[name] not in plan(catalog.queries()[name](spark, sf_dir))
