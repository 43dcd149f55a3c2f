"""Queries of the feature matrix, strategies, composites, pairs, folds, votes and sizes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import change, div, pct_rank, rounded, series
from ..operators import pair_paths
from ..operators import portfolio as p
from ..operators import strategies as s
from ..operators import technical as t
from ..sources import market as m
from .cross import rank_sql
from .portfolio import SCORED, scored
from .registry import ORACLES, query, sql
from .signals import P20, PAIRS, closes
from .technical import W, r, roll

KEYS = ["symbol", "date"]


def beside(*names: str, more: str = "") -> str:
    """The rows of several registered queries side by side."""
    first, *rest = (f"({ORACLES[n]})" for n in names)
    return f"SELECT * FROM {first} AS q0" + "".join(f" JOIN {x} AS q{k + 1} USING (symbol, date)" for k, x in enumerate(rest)) + more


def technical_matrix(spark, sf_dir):
    """One row per symbol and date with all technical features: windows by symbol only, one shuffle after the bars."""
    return t.matrix(m.daily_bars(spark, sf_dir))


MATRIX = ["rsi", "macd", "macd_signal", "macd_histogram", "bb_mid", "bb_upper", "bb_lower", "bb_position", "atr", "stoch_k", "stoch_d", "plus_di", "minus_di", "adx", "obv", "obv_mean", "vwap"]
PIECES = ["W3_rsi", "W4_macd", "W5_bollinger", "W6_atr", "W7_stochastic", "W8_adx", "W9_obv", "W10_vwap"]


@query("W11_technical_matrix", beside(*PIECES))
def technical_features(spark, sf_dir):
    return rounded(technical_matrix(spark, sf_dir).select(*KEYS, *MATRIX), *KEYS)


@query("W39_feature_matrix", beside(*PIECES, "W12_price_features", "W13_regime_features", "W14_momentum_quality"))
def feature_matrix(spark, sf_dir):
    """The whole feature row: technical, price, regime and momentum features in one pass over a symbol's bars."""
    out = t.price_features(technical_matrix(spark, sf_dir), keep=[*MATRIX, "close"])
    out = t.regime_features(out, keep=[c for c in out.columns if c not in KEYS and c != "close"] + ["close"])
    out = t.momentum_quality(out, keep=[c for c in out.columns if c not in KEYS and c != "close"])
    return rounded(out, *KEYS)


STRATEGIES = f"""f AS (SELECT *, (close - ({roll('avg', 'close', 20)})) / nullif({roll('stddev_samp', 'close', 20)}, 0) AS z, ({roll('avg', 'close', 20)}) / nullif({roll('avg', 'close', 50)}, 0) - 1 AS t, close / nullif(lag(close, 63) OVER w, 0) - 1 AS m,
CASE WHEN count(high) OVER {P20} >= 20 THEN max(high) OVER {P20} END AS hi, CASE WHEN count(low) OVER {P20} >= 20 THEN min(low) OVER {P20} END AS lo FROM bars {W}),
st AS (SELECT *, CASE WHEN z > 2 THEN -1 WHEN z < -2 THEN 1 ELSE 0 END AS reversion_signal, coalesce(least(abs(z / 3), 1.0), 0.0) AS reversion_confidence, CAST(coalesce(sign(t), 0) AS INTEGER) AS trend_signal, coalesce(least(abs(t * 10), 1.0), 0.0) AS trend_confidence,
CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE 0 END AS breakout_signal, coalesce(least(abs(close / nullif((hi + lo) / 2, 0) - 1), 1.0), 0.0) AS breakout_confidence, CAST(coalesce(sign(m), 0) AS INTEGER) AS momentum_signal, coalesce(least(abs(m), 1.0), 0.0) AS momentum_confidence FROM f)"""


def weighted(weights: tuple[float, ...]) -> str:
    return " + ".join(f"{w} * {n}_signal * {n}_confidence" for n, w in zip(s.NAMES, weights))


@query("G2_strategies", sql("bars", f", {STRATEGIES} SELECT symbol, date, {', '.join(f'{n}_signal' for n in s.NAMES)}, {r(**{f'{n}_confidence': f'{n}_confidence' for n in s.NAMES})} FROM st"))
def strategies(spark, sf_dir):
    return rounded(s.strategies(m.daily_bars(spark, sf_dir)).select(*KEYS, *(f"{n}_{x}" for n in s.NAMES for x in ("signal", "confidence"))), *KEYS)


@query("W38_strategy_features", sql("bars", f", {STRATEGIES} SELECT symbol, date, {r(**{n: f'{n}_signal * {n}_confidence' for n in s.NAMES})}, CAST(coalesce(sign(({roll('avg', 'close', 5)}) - ({roll('avg', 'close', 20)})), 0) AS DOUBLE) AS crossover FROM st"))
def strategy_features(spark, sf_dir):
    out = s.strategies(m.daily_bars(spark, sf_dir))
    cross = F.coalesce(F.signum(F.when(F.count("close").over(series().rowsBetween(-19, 0)) >= 20, F.avg("close").over(series().rowsBetween(-4, 0)) - F.avg("close").over(series().rowsBetween(-19, 0)))), F.lit(0.0))
    return rounded(out.select(*KEYS, *((F.col(f"{n}_signal") * F.col(f"{n}_confidence")).alias(n) for n in s.NAMES), cross.alias("crossover")), *KEYS)


WEIGHTS = {"trending": (0.1, 0.4, 0.2, 0.3), "reverting": (0.6, 0.1, 0.1, 0.2), "mixed": (0.25, 0.25, 0.25, 0.25)}
STATE = f"""ax AS ({ORACLES['W8_adx']}), lt AS (SELECT symbol, adx, ret, close / nullif(lag(close, 5) OVER w, 0) - 1 AS r5, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM rets JOIN ax USING (symbol, date) {W}),
sg AS (SELECT symbol, avg(adx) AS a, var_samp(r5) / nullif(5 * var_samp(ret), 0) AS q FROM lt WHERE k <= 30 GROUP BY symbol), state AS (SELECT symbol, CASE WHEN a > 25 THEN 'trending' WHEN q < 1 THEN 'reverting' ELSE 'mixed' END AS regime FROM sg)"""
COMPOSITE = f"co AS (SELECT symbol, date, regime, CASE regime {' '.join(f'''WHEN '{k}' THEN {weighted(w)}''' for k, w in WEIGHTS.items())} END AS composite FROM st JOIN state USING (symbol))"


def regime_composite(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir)
    state = s.last_regime(t.adx(bars).withColumn("ret", change("close")).withColumn("ret_5", change("close", 5)))
    return s.composite(s.strategies(bars), state, WEIGHTS)


@query("G3_regime_composite", sql("rets", f", {STRATEGIES}, {STATE}, {COMPOSITE} SELECT symbol, date, regime, round(composite, 6) AS composite FROM co"))
def composite(spark, sf_dir):
    return rounded(regime_composite(spark, sf_dir), *KEYS)


ADAPTIVE = {"wild trend": (0.1, 0.4, 0.2, 0.3), "wild range": (0.6, 0.1, 0.1, 0.2), "calm trend": (0.1, 0.5, 0.1, 0.3), "calm range": (0.5, 0.2, 0.1, 0.2)}


@query("G4_adaptive_composite", sql("rets", f""", {STRATEGIES}, v AS (SELECT symbol, date, ({roll('stddev_samp', 'ret', 20)}) / nullif({roll('stddev_samp', 'ret', 63)}, 0) AS v FROM rets),
b AS (SELECT st.*, CASE WHEN coalesce(v > 1.2, false) AND coalesce(abs(t) > 0.1, false) THEN 'wild trend' WHEN coalesce(v > 1.2, false) THEN 'wild range' WHEN coalesce(abs(t) > 0.1, false) THEN 'calm trend' ELSE 'calm range' END AS regime FROM st JOIN v USING (symbol, date)),
c AS (SELECT symbol, date, t, regime, CASE regime {' '.join(f"WHEN '{k}' THEN {weighted(w)}" for k, w in ADAPTIVE.items())} END AS c FROM b)
SELECT symbol, date, regime, round(CASE WHEN c * coalesce(t, 0.0) < 0 THEN 0.25 * c ELSE c END, 6) AS composite FROM c"""))
def adaptive(spark, sf_dir):
    return rounded(s.adaptive(s.strategies(m.daily_bars(spark, sf_dir))), *KEYS)


@query("G5_enhanced_composite", sql("rets", f""", {STRATEGIES}, {STATE}, {COMPOSITE}, k AS (SELECT symbol, date, 2 * ({rank_sql('m')}) - 1 AS score FROM f), x AS (SELECT symbol, date, composite, coalesce(score, 0.0) AS sc, 0.6 * composite + 0.4 * coalesce(score, 0.0) AS mix FROM co LEFT JOIN k USING (symbol, date))
SELECT symbol, date, round(least(greatest(CASE WHEN sign(composite) * sign(sc) > 0 THEN 1.2 * mix ELSE mix END, -1.0), 1.0), 6) AS signal FROM x"""))
def enhanced(spark, sf_dir):
    """The regime composite blended with the cross-sectional rank of 63-row momentum."""
    ranks = m.daily_bars(spark, sf_dir).withColumn("_m", change("close", 63)).select(*KEYS, (2 * pct_rank("_m") - 1).alias("score"))
    return rounded(s.enhanced(regime_composite(spark, sf_dir), ranks), *KEYS)


ZS = f"""e AS (SELECT p.a, p.b, p.date, p.x, p.y, ps.hedge, p.y - ps.hedge * p.x - ps.intercept AS e FROM p JOIN ps ON p.a = ps.a AND p.b = ps.b),
zs AS (SELECT *, CASE WHEN count(e) OVER v >= 20 THEN (e - avg(e) OVER v) / nullif(stddev_samp(e) OVER v, 0) END AS z FROM e WINDOW v AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
po AS (SELECT a, b, date, x, y, hedge, CAST(list_reduce(list_prepend(0.0, list(coalesce(z, 99.0)) OVER (PARTITION BY a, b ORDER BY date)), lambda s, v: CASE WHEN v = 99.0 THEN s WHEN s = 0 THEN CASE WHEN v > 2 THEN -1.0 WHEN v < -2 THEN 1.0 ELSE 0.0 END WHEN abs(v) < 0.5 THEN 0.0 ELSE s END) AS INTEGER) AS position FROM zs)"""


@query("G12_pair_positions", sql("bars sectors", f", {PAIRS}, {ZS} SELECT a, b, date, position FROM po"))
def pair_positions(spark, sf_dir):
    return pair_paths.positions(*closes(spark, sf_dir))


@query("G12_pair_profit", sql("bars sectors", f""", {PAIRS}, {ZS}, h AS (SELECT *, lag(position) OVER v AS held, y / nullif(lag(y) OVER v, 0) - 1 - (x / nullif(lag(x) OVER v, 0) - 1) AS move FROM po WINDOW v AS (PARTITION BY a, b ORDER BY date))
SELECT date, round(avg(held * move), 6) AS ret, count(*) AS n FROM h WHERE held <> 0 GROUP BY date"""))
def pair_profit(spark, sf_dir):
    return rounded(pair_paths.daily_profit(*closes(spark, sf_dir)), "date", "n")


@query("G13_pair_confirmation", sql("rets sectors", f""", {PAIRS}, k AS (SELECT symbol, date, {roll('avg', 'ret', 5)} AS f FROM rets), j AS (SELECT p.a, p.b, p.date, u.f AS fa, v.f AS fb FROM p LEFT JOIN k u ON p.a = u.symbol AND p.date = u.date LEFT JOIN k v ON p.b = v.symbol AND p.date = v.date)
SELECT a, b, date, round((last_value(fa IGNORE NULLS) OVER w + last_value(fb IGNORE NULLS) OVER w) / 2, 6) AS confirmation FROM j WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def pair_confirmation(spark, sf_dir):
    from ..functions.frames import rolling

    features = m.with_returns(m.daily_bars(spark, sf_dir)).withColumn("f", rolling("mean", "ret", 5))
    return rounded(pair_paths.confirmation(features.join(m.sectors(spark, sf_dir), "symbol"), "industry", "f"), "a", "b", "date")


FOLDS = """d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
fo AS (SELECT CAST(f AS BIGINT) AS fold, date, CASE WHEN d - f * 100 < 400 THEN 'train' ELSE 'test' END AS part FROM d, range(0, 10000) AS r(f) WHERE d < f * 100 + 500 AND f * 100 + 500 <= n {low})"""


@query("V19_expanding_folds", sql("bars", f", {FOLDS.format(low='')} SELECT fold, part, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars JOIN fo USING (date) GROUP BY 1, 2"))
def expanding_folds(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir)
    return bars.join(F.broadcast(s.folds(bars, 400, 100, True)), "date").groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


DAILY = f"""{SCORED}, dk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rk FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL),
dd AS (SELECT k, threshold, date, avg(forward_return) AS ret FROM dk, (VALUES (3), (5), (10)) AS a(k), (VALUES (0.0), (0.5), (0.8)) AS b(threshold) WHERE rk <= k AND score >= threshold GROUP BY k, threshold, date)"""
BEST = f"""{FOLDS.format(low='AND d >= f * 100')}, {DAILY}, su AS (SELECT fold, CAST(k AS INTEGER) AS k, CAST(threshold AS DOUBLE) AS threshold, avg(CASE WHEN part = 'train' THEN ret END) AS train, count(CASE WHEN part = 'train' THEN 1 END) AS n, avg(CASE WHEN part = 'test' THEN ret END) AS test FROM dd JOIN fo USING (date) GROUP BY 1, 2, 3),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(train, 9) DESC, k, threshold) AS rk FROM su WHERE n >= 50) WHERE rk = 1)"""


def best_by_fold(spark, sf_dir):
    from pyspark.sql.window import Window

    rows = scored(spark, sf_dir)
    w = Window.partitionBy("date").orderBy(F.desc("score"), "symbol")
    ranked = rows.where("score is not null and forward_return is not null").withColumn("_k", F.row_number().over(w)).where("_k <= 10")
    grid = ranked.withColumn("k", F.explode(F.array(*map(F.lit, (3, 5, 10))))).where("_k <= k").withColumn("threshold", F.explode(F.array(*map(F.lit, (0.0, 0.5, 0.8))))).where("score >= threshold")
    daily = grid.groupBy("k", "threshold", "date").agg(F.avg("forward_return").alias("ret"))
    parts = s.folds(m.daily_bars(spark, sf_dir), 400, 100, False)
    return s.search(daily, parts, 50)


@query("V48_walk_forward_search", sql("bars", f", {BEST} SELECT fold, k, threshold, {r(train='train', test='test')} FROM be"))
def walk_forward_search(spark, sf_dir):
    return rounded(best_by_fold(spark, sf_dir), "fold", "k")


@query("V20_parameter_stability", sql("bars", f", {BEST} SELECT k, threshold, count(*) AS n, {r(mean_test='avg(test)', std_test='stddev_samp(test)')} FROM be GROUP BY k, threshold"))
def parameter_stability(spark, sf_dir):
    return rounded(s.stability(best_by_fold(spark, sf_dir)), "k", "n")


MODELS = f"""f3 AS (SELECT symbol, date, ret, close / nullif(lag(close, 5) OVER w, 0) - 1 AS r5, close / nullif(lag(close, 21) OVER w, 0) - 1 AS r21 FROM rets {W}),
mo3 AS (SELECT symbol, date, ret, {rank_sql('ret')} AS p1, {rank_sql('r5')} AS p2, {rank_sql('r21')} AS p3 FROM f3)"""


def models(spark, sf_dir):
    """Three cross-sectional ranks that stand in for the probabilities of three models."""
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).withColumn("_r5", change("close", 5)).withColumn("_r21", change("close", 21))
    rows = m.dealt(rows.select(*KEYS, "ret", "_r5", "_r21"), spark, sf_dir, "date")
    return rows.select(*KEYS, "ret", pct_rank("ret").alias("p1"), pct_rank("_r5").alias("p2"), pct_rank("_r21").alias("p3"))


@query("G19_votes", sql("rets", f""", {MODELS} SELECT symbol, date, {r(soft='(coalesce(p1 * 0.5, 0.0) + coalesce(p2 * 0.3, 0.0) + coalesce(p3 * 0.2, 0.0)) / nullif(CASE WHEN p1 IS NOT NULL THEN 0.5 ELSE 0.0 END + CASE WHEN p2 IS NOT NULL THEN 0.3 ELSE 0.0 END + CASE WHEN p3 IS NOT NULL THEN 0.2 ELSE 0.0 END, 0)',
hard='(coalesce(CAST(p1 > 0.5 AS DOUBLE), 0.0) + coalesce(CAST(p2 > 0.5 AS DOUBLE), 0.0) + coalesce(CAST(p3 > 0.5 AS DOUBLE), 0.0)) / nullif(CAST(p1 IS NOT NULL AS INTEGER) + CAST(p2 IS NOT NULL AS INTEGER) + CAST(p3 IS NOT NULL AS INTEGER), 0)', spread='greatest(p1, p2, p3) - least(p1, p2, p3)')} FROM mo3"""))
def votes(spark, sf_dir):
    return rounded(s.vote(models(spark, sf_dir), {"p1": 0.5, "p2": 0.3, "p3": 0.2}).select(*KEYS, "soft", "hard", "spread"), *KEYS)


@query("G20_error_weights", sql("rets", f""", {MODELS}, er AS (SELECT symbol, date, {', '.join(f'abs(p{k} - CAST(lead(ret) OVER w > 0 AS DOUBLE)) AS e{k}' for k in (1, 2, 3))} FROM mo3 {W}),
wt AS (SELECT symbol, date, {', '.join(f'1 / (1 + coalesce(avg(e{k}) OVER v, 0.0)) AS w{k}' for k in (1, 2, 3))} FROM er WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT symbol, date, {r(**{f'weight_e{k}': f'w{k} / (w1 + w2 + w3)' for k in (1, 2, 3)})} FROM wt"""))
def error_weights(spark, sf_dir):
    from ..functions.frames import lead

    rows = models(spark, sf_dir).withColumn("_up", (lead("ret") > 0).cast("double"))
    rows = rows.select(*KEYS, *(F.abs(F.col(f"p{k}") - F.col("_up")).alias(f"e{k}") for k in (1, 2, 3)))
    return rounded(s.error_weights(rows, ["e1", "e2", "e3"]).drop("e1", "e2", "e3"), *KEYS)


@query("G30_target_weights", sql("bars", f""", {STRATEGIES}, k AS (SELECT symbol, date, momentum_signal * momentum_confidence AS s FROM st WHERE abs(momentum_signal * momentum_confidence) > 0.05), n AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(s) DESC, symbol) AS rk FROM k)
SELECT symbol, date, round(s / nullif(sum(abs(s)) OVER (PARTITION BY date), 0), 6) AS weight FROM n WHERE rk <= 10"""))
def target_weights(spark, sf_dir):
    out = s.strategies(m.daily_bars(spark, sf_dir))
    return rounded(s.targets(out, "momentum_signal", "momentum_confidence", 0.05, 10), *KEYS)


SIZES = f"""kl AS (SELECT symbol, avg(CAST(ret > 0 AS DOUBLE)) AS win, avg(CASE WHEN ret > 0 THEN ret END) / nullif(-avg(CASE WHEN ret < 0 THEN ret END), 0) AS pay FROM rets WHERE ret IS NOT NULL AND ret <> 0 GROUP BY symbol),
vd AS (SELECT symbol, date, ({roll('stddev_samp', 'ret', 20)}) * sqrt(252.0) AS vol, coalesce(sign(ret), 0) AS sgn, close / nullif(max(close) OVER w, 0) - 1 AS dd FROM rets {W})"""


def sized(spark, sf_dir):
    from ..functions.frames import rolling, so_far

    rows = m.with_returns(m.daily_bars(spark, sf_dir))
    rows = rows.withColumn("vol", rolling("std", "ret", 20) * F.sqrt(F.lit(252.0))).withColumn("dd", div("close", F.max("close").over(so_far())) - 1)
    return rows.join(p.kelly(rows, "symbol").select("symbol", "win_rate", "payoff"), "symbol", "left")


@query("G33_position_size", sql("rets", f""", {SIZES}, b AS (SELECT symbol, date, (0.5 * coalesce(least(greatest(win - (1 - win) / nullif(pay, 0), 0.0), 1.0), 0.0) / 2 + 0.5 * least(coalesce(0.15 / nullif(vol, 0), 0.0), 1.0)) * CASE WHEN -dd < 0.05 THEN 1.0 WHEN -dd < 0.1 THEN 0.75 WHEN -dd < 0.2 THEN 0.5 ELSE 0.25 END * sgn AS x FROM vd LEFT JOIN kl USING (symbol))
SELECT symbol, date, round(least(greatest(x, -0.25), 0.25), 6) AS size FROM b"""))
def position_size(spark, sf_dir):
    size = s.position_size(F.col("win_rate"), F.col("payoff"), F.col("vol"), F.col("dd"), F.coalesce(F.signum("ret"), F.lit(0.0)))
    return rounded(sized(spark, sf_dir).select(*KEYS, size.alias("size")), *KEYS)


@query("G32_risk_steps", sql("rets", f""", {SIZES} SELECT symbol, date, CAST(CASE WHEN -dd < 0.05 THEN 1.0 WHEN -dd < 0.1 THEN 0.8 WHEN -dd < 0.2 THEN 0.6 ELSE 0.4 END AS DOUBLE) AS threshold_scale, CAST(CASE WHEN vol < 5 THEN 0.0 WHEN vol < 10 THEN 0.25 WHEN vol < 20 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS put_coverage,
round(CASE WHEN vol IS NOT NULL THEN least(greatest(0.02 * vol, 0.02), 0.2) END, 6) AS stop_distance, round(CASE WHEN vol IS NOT NULL THEN least(greatest(-dd * 2, 0.0), 1.0) END, 6) AS hedge_ratio FROM vd"""))
def risk_steps(spark, sf_dir):
    """Threshold scale by drawdown, put coverage by volatility (none known: all), stop distance and hedge ratio."""
    from ..functions.frames import clip

    rows = sized(spark, sf_dir)
    fall = -F.col("dd")
    known = F.col("vol").isNotNull()
    return rounded(rows.select(*KEYS, s.stepped(fall, [(0.05, 1.0), (0.1, 0.8), (0.2, 0.6)], 0.4).alias("threshold_scale"), s.stepped(F.col("vol"), [(5, 0.0), (10, 0.25), (20, 0.5)], 1.0).alias("put_coverage"), F.when(known, clip(0.02 * F.col("vol"), 0.02, 0.2)).alias("stop_distance"), F.when(known, clip(fall * 2, 0.0, 1.0)).alias("hedge_ratio")), *KEYS)


@query("R13_factors", sql("rets", f""", f4 AS (SELECT symbol, date, close / nullif(lag(close, 63) OVER w, 0) - 1 AS mo, {roll('stddev_samp', 'ret', 20)} AS vo, volume AS li, {roll('avg', 'ret', 5)} AS rv FROM rets {W}),
zz AS (SELECT symbol, date, {', '.join(f'CASE WHEN stddev_pop(coalesce({c}, 0.0)) OVER d <= 1e-12 THEN 0.0 ELSE (coalesce({c}, 0.0) - avg(coalesce({c}, 0.0)) OVER d) / nullif(stddev_pop(coalesce({c}, 0.0)) OVER d, 0.0) END AS z{c}' for c in ('mo', 'vo', 'li', 'rv'))} FROM f4 WINDOW d AS (PARTITION BY date))
SELECT symbol, date, {r(trend_factor='(zmo - zrv) / 2', risk_factor='zvo', liquidity_factor='(zli - zvo) / 2', reversal_factor='-zrv')} FROM zz"""))
def factors(spark, sf_dir):
    """Four factors of a date from z of momentum, volatility, volume and short-term return."""
    from ..functions.frames import cross_z, rolling

    rows = m.with_returns(m.daily_bars(spark, sf_dir)).select(*KEYS, change("close", 63).alias("mo"), rolling("std", "ret", 20).alias("vo"), F.col("volume").alias("li"), rolling("mean", "ret", 5).alias("rv"))
    z = rows.select(*KEYS, *(cross_z(c).alias(f"z{c}") for c in ("mo", "vo", "li", "rv")))
    return rounded(z.select(*KEYS, ((F.col("zmo") - F.col("zrv")) / 2).alias("trend_factor"), F.col("zvo").alias("risk_factor"), ((F.col("zli") - F.col("zvo")) / 2).alias("liquidity_factor"), (-F.col("zrv")).alias("reversal_factor")), *KEYS)


@query("M12_imbalance_signal", sql("bars", f""", i AS (SELECT symbol, date, (2 * close - high - low) / nullif(high - low, 0) AS i FROM bars), a AS (SELECT symbol, date, {roll('avg', 'i', 5, 3)} AS a FROM i)
SELECT symbol, date, round(a, 6) AS imbalance, CASE WHEN a > 0.3 THEN 1 WHEN a < -0.3 THEN -1 ELSE 0 END AS signal FROM a"""))
def imbalance_signal(spark, sf_dir):
    """The mean place of the close in the day's range over five rows, and its sign beyond 0.3."""
    from ..functions.frames import rolling

    rows = m.daily_bars(spark, sf_dir).withColumn("_i", div(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low"))).withColumn("imbalance", rolling("mean", "_i", 5, 3))
    return rounded(rows.select(*KEYS, "imbalance", F.when(F.col("imbalance") > 0.3, 1).when(F.col("imbalance") < -0.3, -1).otherwise(0).alias("signal")), *KEYS)

