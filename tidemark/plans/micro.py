"""Queries of microstructure and path features, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.frames import rounded
from ..operators import joins
from ..operators import micro as mi
from ..sources import market as m
from .registry import query, sql
from .technical import W, last, r, roll

LN2 = math.log(2.0)


def cdf(x: str) -> str:
    """The same rational approximation, as SQL."""
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = f"(1 / (1 + 0.5 * (abs({x}) / sqrt(2.0))))"
    poly = str(c[-1])
    for k in reversed(c[:-1]):
        poly = f"({k} + {t} * {poly})"
    tail = f"({t} * exp(-(abs({x}) / sqrt(2.0)) * (abs({x}) / sqrt(2.0)) + {poly}) / 2)"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


@query("M1_quote_spread", sql("quotes", f", s AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread FROM quotes) SELECT event_id, {r(mid='mid', spread='spread', relative_spread='spread / nullif(mid, 0)', spread_mean='avg(spread) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} FROM s"))
def quote_spread(spark, sf_dir):
    return rounded(mi.quote_spread(m.quotes(spark, sf_dir)).select("event_id", "mid", "spread", "relative_spread", "spread_mean"), "event_id")


@query("M2_roll_spread", sql("rets", f""", b AS (SELECT *, lag(ret) OVER w AS b FROM rets {W}), c AS (SELECT symbol, date, CASE WHEN ret IS NOT NULL AND b IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL AND b IS NOT NULL THEN b END AS y FROM b),
v AS (SELECT symbol, date, CASE WHEN count(x) OVER {last(19)} >= 19 THEN covar_samp(x, y) OVER {last(19)} END AS c FROM c) SELECT symbol, date, round(CASE WHEN c IS NOT NULL THEN 2 * sqrt(greatest(-c, 0.0)) END, 6) AS roll_spread FROM v"""))
def roll_spread(spark, sf_dir):
    return rounded(mi.roll_spread(m.daily_bars(spark, sf_dir)).select("symbol", "date", "roll_spread"), "symbol", "date")


@query("M3_high_low_spread", sql("bars", f""", a AS (SELECT *, ln(high / low) ** 2 AS hl, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars {W}), b AS (SELECT *, hl + lag(hl) OVER w AS beta, ln(greatest(high, ph) / least(low, pl)) ** 2 AS gamma FROM a {W}),
c AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0)) - sqrt(gamma / (3 - 2 * sqrt(2.0))) AS alpha FROM b)
SELECT symbol, date, round(CASE WHEN beta IS NOT NULL THEN greatest(2 * (exp(least(alpha, 50.0)) - 1) / (1 + exp(least(alpha, 50.0))), 0.0) END, 6) AS high_low_spread FROM c"""))
def high_low_spread(spark, sf_dir):
    return rounded(mi.high_low_spread(m.daily_bars(spark, sf_dir)).select("symbol", "date", "high_low_spread"), "symbol", "date")


@query("M4_close_mid_spread", sql("bars", f""", a AS (SELECT *, (ln(high) + ln(low)) / 2 AS m FROM bars), b AS (SELECT symbol, date, 4 * (ln(close) - m) * (ln(close) - lead(m) OVER w) AS v FROM a {W})
SELECT symbol, date, round(CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 0.0)) END, 6) AS close_mid_spread FROM b"""))
def close_mid_spread(spark, sf_dir):
    return rounded(mi.close_mid_spread(m.daily_bars(spark, sf_dir)).select("symbol", "date", "close_mid_spread"), "symbol", "date")


FLOW = "fl AS (SELECT symbol, date, coalesce((2 * close - high - low) / nullif(high - low, 0), 0.0) * volume AS flow FROM bars)"


@query("M7_bar_flow", sql("bars", f""", {FLOW}, g AS (SELECT *, sum(flow) OVER w AS flow_cum, {roll('avg', 'flow', 10)} AS flow_mean FROM fl {W})
SELECT symbol, date, {r(flow='flow', flow_cum='flow_cum', flow_mean='flow_mean', flow_momentum='flow_mean - lag(flow_mean, 10) OVER w')} FROM g {W}"""))
def bar_flow(spark, sf_dir):
    return rounded(mi.bar_flow(m.daily_bars(spark, sf_dir)).select("symbol", "date", "flow", "flow_cum", "flow_mean", "flow_momentum"), "symbol", "date")


@query("M8_flow_signal", sql("bars", f""", {FLOW}, z AS (SELECT symbol, date, (flow - ({roll('avg', 'flow', 20)})) / nullif({roll('stddev_samp', 'flow', 20)}, 0) AS z FROM fl)
SELECT symbol, date, CASE WHEN z > 2 THEN 1 WHEN z < -2 THEN -1 ELSE 0 END AS signal FROM z"""))
def flow_signal(spark, sf_dir):
    return mi.flow_signal(m.daily_bars(spark, sf_dir)).select("symbol", "date", "signal")


TICK = """t1 AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id)) AS s FROM trades),
t2 AS (SELECT *, CAST(coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS INTEGER) AS tick_sign FROM t1)"""


@query("M9_quote_rule", sql("trades quotes", f""", {TICK} SELECT t.event_id, CASE WHEN t.price > (q.bid + q.ask) / 2 THEN 1 WHEN t.price < (q.bid + q.ask) / 2 THEN -1 ELSE tick_sign END AS sign FROM t2 t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts"""))
def quote_rule(spark, sf_dir):
    met = joins.as_of(m.trades(spark, sf_dir), m.quotes(spark, sf_dir).select("symbol", "ts", "bid", "ask"), "ts", ["bid", "ask"])
    return mi.quote_rule(met).select("event_id", "sign")


@query("M10_tick_rule", sql("trades", f", {TICK} SELECT event_id, tick_sign FROM t2"))
def tick_rule(spark, sf_dir):
    return mi.tick_rule(m.trades(spark, sf_dir)).select("event_id", "tick_sign")


@query("M11_bulk_volume", sql("bars", f""", a AS (SELECT *, close - lag(close) OVER w AS d FROM bars {W}), b AS (SELECT symbol, date, volume, d / nullif({roll('stddev_samp', 'd', 20)}, 0) AS z FROM a), c AS (SELECT *, {cdf('z')} AS p FROM b)
SELECT symbol, date, {r(buy_share='CASE WHEN z IS NOT NULL THEN p END', buy_volume='CASE WHEN z IS NOT NULL THEN p * volume END', imbalance='CASE WHEN z IS NOT NULL THEN 2 * p - 1 END')} FROM c"""))
def bulk_volume(spark, sf_dir):
    return rounded(mi.bulk_volume(m.daily_bars(spark, sf_dir)).select("symbol", "date", "buy_share", "buy_volume", "imbalance"), "symbol", "date")


K20 = 0.34 / (1.34 + 21 / 19)


@query("M13_range_volatility", sql("bars", f""", a AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(open / lag(close) OVER w) AS o, ln(high / low) AS hl, ln(high / open) AS ho, ln(low / open) AS lo, ln(close / open) AS co FROM bars {W}),
b AS (SELECT *, hl * hl / (4 * {LN2!r}) AS pk, 0.5 * hl * hl - (2 * {LN2!r} - 1) * co * co AS gk, ho * (ho - co) + lo * (lo - co) AS rs FROM a),
c AS (SELECT symbol, date, {roll('stddev_samp', 'r', 20)} AS vc, {roll('avg', 'pk', 20)} AS pk, {roll('avg', 'gk', 20)} AS gk, {roll('avg', 'rs', 20)} AS rs, ({roll('var_samp', 'o', 20)}) + {K20!r} * ({roll('var_samp', 'co', 20)}) + (1 - {K20!r}) * ({roll('avg', 'rs', 20)}) AS yz FROM b)
SELECT symbol, date, {r(vol_close='vc', **{f'vol_{n}': f'CASE WHEN {k} IS NOT NULL THEN sqrt(greatest({k}, 0.0)) END' for n, k in (('parkinson', 'pk'), ('garman_klass', 'gk'), ('rogers_satchell', 'rs'), ('yang_zhang', 'yz'))})} FROM c"""))
def range_volatility(spark, sf_dir):
    return rounded(mi.range_volatility(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M14_whole_volatility", sql("bars", f""", a AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(high / low) AS hl FROM bars {W})
SELECT symbol, {r(vol_close='stddev_samp(r) * sqrt(252.0)', vol_parkinson=f'sqrt(avg(hl * hl) / (4 * {LN2!r}) * 252)')} FROM a GROUP BY symbol"""))
def whole_volatility(spark, sf_dir):
    return rounded(mi.whole_volatility(m.daily_bars(spark, sf_dir)), "symbol")


SIG = f"""sg AS (SELECT symbol, step, CAST(step AS INTEGER) AS st, date, close FROM (SELECT *, row_number() OVER w AS rn FROM bars {W}), (VALUES (1), (2), (5), (10)) AS s(step) WHERE rn % step = 0),
s2 AS (SELECT symbol, step, ln(close / lag(close) OVER (PARTITION BY symbol, step ORDER BY date)) AS r FROM sg), s3 AS (SELECT symbol, step, stddev_samp(r) / sqrt(step) AS vol FROM s2 GROUP BY symbol, step)"""


@query("M15_signature", sql("bars", f", {SIG} SELECT symbol, CAST(step AS INTEGER) AS step, round(vol, 6) AS vol FROM s3"))
def signature(spark, sf_dir):
    return rounded(mi.signature(m.daily_bars(spark, sf_dir)), "symbol", "step")


@query("M16_best_step", sql("bars", f", {SIG}, d AS (SELECT symbol, step, abs(vol - lag(vol) OVER (PARTITION BY symbol ORDER BY step)) AS d FROM s3) SELECT symbol, CAST(first(step ORDER BY d, step) AS INTEGER) AS step FROM d WHERE d IS NOT NULL GROUP BY symbol"))
def best_step(spark, sf_dir):
    return mi.best_step(mi.signature(m.daily_bars(spark, sf_dir)))


@query("M20_path_shape", sql("rets", f""", a AS (SELECT *, CASE WHEN ret < 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0.0 END AS dn, abs(ret) AS ar FROM rets)
SELECT symbol, date, {r(skew=roll('skewness', 'ret', 21), kurt=roll('kurtosis', 'ret', 21), downside=f"CASE WHEN count(ret) OVER {last(21)} >= 21 THEN sqrt(avg(dn) OVER {last(21)}) END",
tail_ratio=f"CASE WHEN count(ret) OVER {last(21)} >= 21 THEN abs(quantile_cont(ret, 0.95) OVER {last(21)}) / nullif(abs(quantile_cont(ret, 0.05) OVER {last(21)}), 0) END", jumpiness=f"CASE WHEN count(ret) OVER {last(21)} >= 21 THEN max(ar) OVER {last(21)} / nullif(sum(ar) OVER {last(21)}, 0) END")} FROM a"""))
def path_shape(spark, sf_dir):
    return rounded(mi.path_shape(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M21_katz_dimension", sql("bars", f""", a AS (SELECT *, abs(close - lag(close) OVER w) AS d FROM bars {W}), b AS (SELECT symbol, date, sum(d) OVER {last(29)} AS len, list(close) OVER {last(30)} AS x FROM a),
c AS (SELECT symbol, date, list_max(list_transform(x, lambda v: abs(v - x[1]))) / nullif(len, 0) AS q FROM b WHERE len(x) = 30)
SELECT symbol, date, round(CASE WHEN q > 0 THEN ln(29) / nullif(ln(29) + ln(q), 0) END, 6) AS katz FROM c"""))
def katz_dimension(spark, sf_dir):
    return rounded(mi.katz_dimension(m.daily_bars(spark, sf_dir)), "symbol", "date")


def _entropy_sql() -> str:
    share = lambda k: f"(count(CASE WHEN p = {k} THEN 1 END) OVER {last(30)} / nullif(CAST(count(p) OVER {last(30)} AS DOUBLE), 0))"
    return "0.0" + "".join(f" - CASE WHEN {share(k)} > 0 THEN {share(k)} * log2({share(k)}) ELSE 0.0 END" for k in range(8))


@query("M22_permutation_entropy", sql("bars", f""", a AS (SELECT symbol, date, close AS c, lag(close) OVER w AS b, lag(close, 2) OVER w AS a FROM bars {W}), q AS (SELECT symbol, date, CASE WHEN a IS NOT NULL THEN CAST(a > b AS INTEGER) * 4 + CAST(b > c AS INTEGER) * 2 + CAST(a > c AS INTEGER) END AS p FROM a)
SELECT symbol, date, round(CASE WHEN count(p) OVER {last(30)} >= 28 THEN ({_entropy_sql()}) / log2(6) END, 6) AS permutation_entropy FROM q"""))
def permutation_entropy(spark, sf_dir):
    return rounded(mi.permutation_entropy(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M24_haar_energy", sql("rets", f""", a AS (SELECT symbol, date, list(ret) FILTER (ret IS NOT NULL) OVER {last(32)} AS x FROM rets), b AS (SELECT symbol, date, x, list_transform(range(0, 16), lambda i: (x[2 * i + 1] + x[2 * i + 2]) / sqrt(2.0)) AS lo, list_transform(range(0, 16), lambda i: (x[2 * i + 1] - x[2 * i + 2]) / sqrt(2.0)) AS d FROM a WHERE len(x) = 32),
c AS (SELECT symbol, date, list_sum(list_transform(x, lambda v: v * v)) AS e, list_sum(list_transform(d, lambda v: v * v)) AS n, list_sum(list_transform(list_transform(range(0, 8), lambda i: (lo[2 * i + 1] - lo[2 * i + 2]) / sqrt(2.0)), lambda v: v * v)) AS d2 FROM b)
SELECT symbol, date, {r(noise_share='n / nullif(e, 0)', detail_share='d2 / nullif(e, 0)', trend_share='1 - n / nullif(e, 0) - d2 / nullif(e, 0)')} FROM c"""))
def haar_energy(spark, sf_dir):
    return rounded(mi.haar_energy(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M26_wasserstein", sql("rets", f""", a AS (SELECT symbol, date, list_sort(list(ret) FILTER (ret IS NOT NULL) OVER {last(20)}) AS a, list_sort(list(ret) FILTER (ret IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)) AS b FROM rets)
SELECT symbol, date, round(list_sum(list_transform(range(1, 21), lambda i: abs(a[i] - b[i]))) / 20, 6) AS wasserstein FROM a WHERE len(a) = 20 AND len(b) = 20"""))
def wasserstein(spark, sf_dir):
    return rounded(mi.wasserstein(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M29_closed_form_paths", sql("bars", f""", a AS (SELECT *, ln(close / lag(close) OVER w) AS r FROM bars {W}), b AS (SELECT symbol, date, ({roll('avg', 'r', 60)}) * 20 AS m, ({roll('stddev_samp', 'r', 60)}) * sqrt(20.0) AS s FROM a),
z AS (SELECT *, (0.0 - m) / nullif(s, 0) AS z0, (ln(1.05) - m) / nullif(s, 0) AS z5, (ln(0.95) - m) / nullif(s, 0) AS d5 FROM b)
SELECT symbol, date, {r(mean_growth='exp(least(m + s * s / 2, 5.0)) - 1', p_up=f"CASE WHEN z0 IS NOT NULL THEN 1 - ({cdf('z0')}) END", p_up_5=f"CASE WHEN z5 IS NOT NULL THEN 1 - ({cdf('z5')}) END", p_down_5=f"CASE WHEN d5 IS NOT NULL THEN {cdf('d5')} END", var_95='1 - exp(m - 1.6448536269514722 * s)')} FROM z"""))
def closed_form_paths(spark, sf_dir):
    return rounded(mi.closed_form_paths(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M32_ou_parameters", sql("bars", f""", a AS (SELECT symbol, ln(close) AS x, lag(ln(close)) OVER w AS b FROM bars {W}), k AS (SELECT symbol, count(*) AS n, regr_slope(x - b, b) AS k, regr_intercept(x - b, b) AS i FROM a WHERE b IS NOT NULL GROUP BY symbol)
SELECT symbol, n, {r(theta='-k', mu='CASE WHEN -k > 0 THEN i / -k END', half_life=f'CASE WHEN -k > 0 THEN {LN2!r} / -k END')} FROM k"""))
def ou_parameters(spark, sf_dir):
    return rounded(mi.ou_parameters(m.daily_bars(spark, sf_dir)), "symbol", "n")


@query("M33_option_values", f"""WITH o AS (SELECT o_orderkey, o_totalprice / 1e5 AS spot, o_totalprice / 1e5 * (0.8 + 0.1 * (o_orderkey % 5)) AS strike, (1 + o_orderkey % 12) / 12.0 AS years, 0.1 + 0.05 * (o_custkey % 7) AS sigma FROM orders WHERE o_totalprice > 0),
d AS (SELECT *, (ln(spot / strike) + (0.021 + sigma * sigma / 2) * years) / (sigma * sqrt(years)) AS d1 FROM o), e AS (SELECT *, d1 - sigma * sqrt(years) AS d2 FROM d), c AS (SELECT *, spot * ({cdf('d1')}) - strike * exp(-0.021 * years) * ({cdf('d2')}) AS c FROM e)
SELECT o_orderkey, {r(call='c', put='c - spot + strike * exp(-0.021 * years)', delta=cdf('d1'), gamma='exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * sigma * sqrt(years))', vega='spot * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(years)')} FROM c""")
def option_values(spark, sf_dir):
    o = m.table(spark, sf_dir, "orders").where("o_totalprice > 0")
    chain = o.select("o_orderkey", (F.col("o_totalprice") / 1e5).alias("spot"), (F.col("o_totalprice") / 1e5 * (0.8 + 0.1 * (F.col("o_orderkey") % 5))).alias("strike"), ((1 + F.col("o_orderkey") % 12) / 12.0).alias("years"), (0.1 + 0.05 * (F.col("o_custkey") % 7)).alias("sigma"))
    return rounded(mi.option_values(chain, rate=0.021).select("o_orderkey", "call", "put", "delta", "gamma", "vega"), "o_orderkey")
