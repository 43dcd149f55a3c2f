"""Queries of the technical features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import change, rounded
from ..operators import technical as t
from ..sources import market as m
from .registry import query, sql

W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def ema_sql(x: str, span: float) -> str:
    """The recursive average as a fold over the values so far."""
    a = 2.0 / (span + 1)
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY date), lambda acc, v: acc * {1 - a!r} + v * {a!r})"


def last(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {last(n)} >= {least or n} THEN {f}({x}) OVER {last(n)} END"


def r(**columns: str) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for n, e in columns.items())


def r8(**columns: str) -> str:
    return ", ".join(f"round({e}, 8) AS {n}" for n, e in columns.items())


@query("W1_moving", sql("bars", f"SELECT symbol, date, {r(mean_20=roll('avg', 'close', 20), std_20=roll('stddev_samp', 'close', 20), min_20=roll('min', 'close', 20), max_20=roll('max', 'close', 20))} FROM bars"))
def moving(spark, sf_dir):
    return rounded(t.moving(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("W2_ema", sql("bars", f"SELECT symbol, date, {r(ema_12=ema_sql('close', 12), ema_252=ema_sql('close', 252))} FROM bars"))
def ema(spark, sf_dir):
    from ..functions.frames import ema as add

    return rounded(add(m.daily_bars(spark, sf_dir), {"ema_12": ("close", 12), "ema_252": ("close", 252)}).select("symbol", "date", "ema_12", "ema_252"), "symbol", "date")


@query("W3_rsi", sql("bars", f""", d AS (SELECT symbol, date, coalesce(close - lag(close) OVER w, 0.0) AS d FROM bars {W}),
g AS (SELECT symbol, date, {ema_sql('greatest(d, 0.0)', 14)} AS g, {ema_sql('greatest(-d, 0.0)', 14)} AS l FROM d)
SELECT symbol, date, round(100 - 100 / (1 + coalesce(g / nullif(l, 0), 0.0)), 6) AS rsi FROM g"""))
def rsi(spark, sf_dir):
    return rounded(t.rsi(m.daily_bars(spark, sf_dir)).select("symbol", "date", "rsi"), "symbol", "date")


@query("W4_macd", sql("bars", f""", a AS (SELECT symbol, date, {ema_sql('close', 12)} - {ema_sql('close', 26)} AS macd FROM bars),
b AS (SELECT *, {ema_sql('macd', 9)} AS s FROM a) SELECT symbol, date, {r(macd='macd', macd_signal='s', macd_histogram='macd - s')} FROM b"""))
def macd(spark, sf_dir):
    return rounded(t.macd(m.daily_bars(spark, sf_dir)).select("symbol", "date", "macd", "macd_signal", "macd_histogram"), "symbol", "date")


@query("W5_bollinger", sql("bars", f""", a AS (SELECT symbol, date, close, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd FROM bars)
SELECT symbol, date, {r(bb_mid='mid', bb_upper='mid + 2.0 * sd', bb_lower='mid - 2.0 * sd', bb_position='(close - (mid - 2.0 * sd)) / nullif((mid + 2.0 * sd) - (mid - 2.0 * sd), 0)')} FROM a"""))
def bollinger(spark, sf_dir):
    return rounded(t.bollinger(m.daily_bars(spark, sf_dir)).select("symbol", "date", "bb_mid", "bb_upper", "bb_lower", "bb_position"), "symbol", "date")


TR = f"tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars {W})"


@query("W6_atr", sql("bars", f", {TR} SELECT symbol, date, round({ema_sql('tr', 14)}, 6) AS atr FROM tr"))
def atr(spark, sf_dir):
    return rounded(t.atr(m.daily_bars(spark, sf_dir)).select("symbol", "date", "atr"), "symbol", "date")


@query("W7_stochastic", sql("bars", f""", a AS (SELECT symbol, date, 100 * ((close - {roll('min', 'low', 14)}) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0)) AS k FROM bars)
SELECT symbol, date, {r(stoch_k='k', stoch_d=roll('avg', 'k', 3))} FROM a"""))
def stochastic(spark, sf_dir):
    return rounded(t.stochastic(m.daily_bars(spark, sf_dir)).select("symbol", "date", "stoch_k", "stoch_d"), "symbol", "date")


@query("W8_adx", sql("bars", f""", {TR}, mv AS (SELECT *, coalesce(high - lag(high) OVER w, 0.0) AS up, coalesce(lag(low) OVER w - low, 0.0) AS dn FROM tr {W}),
e AS (SELECT symbol, date, {ema_sql('tr', 14)} AS a, {ema_sql('CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END', 14)} AS p, {ema_sql('CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END', 14)} AS n FROM mv),
i AS (SELECT symbol, date, coalesce(100 * (p / nullif(a, 0)), 0.0) AS pdi, coalesce(100 * (n / nullif(a, 0)), 0.0) AS mdi FROM e),
x AS (SELECT *, coalesce(100 * (abs(pdi - mdi) / nullif(pdi + mdi, 0)), 0.0) AS dx FROM i)
SELECT symbol, date, {r(plus_di='pdi', minus_di='mdi', adx=ema_sql('dx', 14))} FROM x"""))
def adx(spark, sf_dir):
    return rounded(t.adx(m.daily_bars(spark, sf_dir)).select("symbol", "date", "plus_di", "minus_di", "adx"), "symbol", "date")


@query("W9_obv", sql("bars", f""", a AS (SELECT symbol, date, coalesce(sign(close - lag(close) OVER w), 0) * volume AS v FROM bars {W}), b AS (SELECT symbol, date, sum(v) OVER w AS obv FROM a {W})
SELECT symbol, date, {r(obv='obv', obv_mean=roll('avg', 'obv', 20))} FROM b"""))
def obv(spark, sf_dir):
    return rounded(t.obv(m.daily_bars(spark, sf_dir)).select("symbol", "date", "obv", "obv_mean"), "symbol", "date")


@query("W10_vwap", sql("bars", f"SELECT symbol, date, round(sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS vwap FROM bars {W}"))
def vwap(spark, sf_dir):
    return rounded(t.vwap(m.daily_bars(spark, sf_dir)).select("symbol", "date", "vwap"), "symbol", "date")


@query("W12_price_features", sql("rets", f""", a AS (SELECT *, CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS DOUBLE) END AS up FROM rets)
SELECT symbol, date, {r(ret_1='ret', ret_5='close / nullif(lag(close, 5) OVER w, 0) - 1', ret_21='close / nullif(lag(close, 21) OVER w, 0) - 1', vol_10=roll('stddev_samp', 'ret', 10), vol_21=roll('stddev_samp', 'ret', 21), vol_63=roll('stddev_samp', 'ret', 63),
from_mean_10=f"close / nullif({roll('avg', 'close', 10)}, 0) - 1", from_mean_20=f"close / nullif({roll('avg', 'close', 20)}, 0) - 1", from_mean_50=f"close / nullif({roll('avg', 'close', 50)}, 0) - 1", cross_10_50=f"{roll('avg', 'close', 10)} / nullif({roll('avg', 'close', 50)}, 0) - 1".replace('CASE', '(CASE', 1).replace('END /', 'END) /', 1),
range_position=f"(close - ({roll('min', 'low', 20)})) / nullif(({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}), 0)", gap='open / nullif(lag(close) OVER w, 0) - 1', volume_ratio=f"volume / nullif({roll('avg', 'volume', 20)}, 0)", up_share_10=roll('avg', 'up', 10), up_share_20=roll('avg', 'up', 20))} FROM a {W}"""))
def price_features(spark, sf_dir):
    return rounded(t.price_features(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("W13_regime_features", sql("rets", f""", a AS (SELECT *, lag(ret) OVER w AS b, ({roll('stddev_samp', 'ret', 20)}) * sqrt(252.0) AS vol FROM rets {W}),
c AS (SELECT *, CASE WHEN ret IS NOT NULL AND b IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL AND b IS NOT NULL THEN b END AS y FROM a)
SELECT symbol, date, {r(vol='vol', vol_z=f"(vol - ({roll('avg', 'vol', 252, 60)})) / nullif({roll('stddev_samp', 'vol', 252, 60)}, 0)", momentum='close / nullif(lag(close, 63) OVER w, 0) - 1', drawdown=f"close / nullif(max(close) OVER {last(252)}, 0) - 1",
trend_strength=f"abs({roll('avg', 'ret', 60)}) / nullif({roll('stddev_samp', 'ret', 60)}, 0)",
autocorr=f"CASE WHEN count(ret) OVER {last(60)} >= 60 THEN covar_samp(x, y) OVER {last(59)} / nullif(stddev_samp(x) OVER {last(59)} * stddev_samp(y) OVER {last(59)}, 0) END", skew=roll('skewness', 'ret', 60), kurt=roll('kurtosis', 'ret', 60))} FROM c {W}"""))
def regime_features(spark, sf_dir):
    return rounded(t.regime_features(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("W14_momentum_quality", sql("rets", f""", a AS (SELECT *, sign(ret) AS s FROM rets)
SELECT symbol, date, {r(sign_consistency=roll('avg', 's', 21), vol_adjusted=f"({roll('sum', 'ret', 63)}) / nullif({roll('stddev_samp', 'ret', 63)}, 0)", skew_21=roll('skewness', 'ret', 21), skew_63=roll('skewness', 'ret', 63))} FROM a"""))
def momentum_quality(spark, sf_dir):
    return rounded(t.momentum_quality(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("W16_forward_label", sql("bars", f""", a AS (SELECT symbol, date, lead(close, 5) OVER w / nullif(close, 0) - 1 AS f, row_number() OVER w AS rn FROM bars {W})
SELECT symbol, date, round(f, 6) AS forward_return, CAST(f > 0 AS INTEGER) AS label FROM a WHERE rn > 20 AND f IS NOT NULL"""))
def forward_label(spark, sf_dir):
    return rounded(t.forward_label(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("W20_rolling_beta", sql("rets", f""", mk AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS mret FROM rets), c AS (SELECT *, CASE WHEN ret IS NOT NULL AND mret IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL AND mret IS NOT NULL THEN mret END AS y FROM mk)
SELECT symbol, date, round(CASE WHEN count(x) OVER {last(63)} >= 15 THEN covar_pop(x, y) OVER {last(63)} / nullif(var_pop(y) OVER {last(63)}, 0) END, 6) AS beta FROM c"""))
def rolling_beta(spark, sf_dir):
    from ..functions.frames import across

    rows = m.with_returns(m.daily_bars(spark, sf_dir)).withColumn("market", F.avg("ret").over(across("date")))
    return rounded(rows.select("symbol", "date", t.rolling_beta("ret", "market").alias("beta")), "symbol", "date")


DD = f"""g AS (SELECT symbol, date, exp(sum(ln(1 + greatest(coalesce(ret, 0.0), -0.999999))) OVER w) AS growth FROM rets {W}),
dd AS (SELECT *, growth / nullif(greatest(max(growth) OVER w, 1.0), 0) - 1 AS drawdown FROM g {W})"""


@query("W22_drawdown", sql("rets", f", {DD} SELECT symbol, date, round(drawdown, 6) AS drawdown FROM dd"))
def drawdown(spark, sf_dir):
    return rounded(t.drawdown(m.with_returns(m.daily_bars(spark, sf_dir))).select("symbol", "date", "drawdown"), "symbol", "date")


@query("W23_drawdown_periods", sql("rets", f""", {DD}, f AS (SELECT *, CAST(drawdown < -0.1 AS INTEGER) AS i, max(date) OVER (PARTITION BY symbol) AS lastd FROM dd), c AS (SELECT *, coalesce(lag(i) OVER w, 0) AS b FROM f {W}), k AS (SELECT *, sum(CAST(i <> b AS INTEGER)) OVER w AS isl FROM c {W})
SELECT symbol, min(date) AS start_date, max(date) AS end_date, round(min(drawdown), 6) AS depth, count(*) AS n_rows FROM k WHERE i = 1 GROUP BY symbol, isl HAVING max(date) < max(lastd)"""))
def drawdown_periods(spark, sf_dir):
    return rounded(t.drawdown_periods(t.drawdown(m.with_returns(m.daily_bars(spark, sf_dir)))), "symbol", "start_date")


@query("W24_longest_runs", sql("rets", f""", a AS (SELECT symbol, date, ret > 0 AS win FROM rets WHERE ret IS NOT NULL AND ret <> 0), c AS (SELECT *, lag(win) OVER w AS b FROM a {W}), b AS (SELECT *, sum(CAST(win IS DISTINCT FROM b AS INTEGER)) OVER w AS run FROM c {W}),
n AS (SELECT symbol, run, win, count(*) AS n FROM b GROUP BY symbol, run, win) SELECT symbol, max(CASE WHEN win THEN n ELSE 0 END) AS max_wins, max(CASE WHEN NOT win THEN n ELSE 0 END) AS max_losses FROM n GROUP BY symbol"""))
def longest_runs(spark, sf_dir):
    return t.longest_runs(m.with_returns(m.daily_bars(spark, sf_dir)))


@query("W25_streak", sql("rets", f""", a AS (SELECT symbol, date, sign(coalesce(ret, 0.0)) AS s FROM rets), c AS (SELECT *, lag(s) OVER w AS b FROM a {W}), b AS (SELECT *, sum(CAST(s IS DISTINCT FROM b AS INTEGER)) OVER w AS run FROM c {W})
SELECT symbol, date, CAST(s * row_number() OVER (PARTITION BY symbol, run ORDER BY date) AS BIGINT) AS streak FROM b"""))
def streak(spark, sf_dir):
    return t.streak(m.with_returns(m.daily_bars(spark, sf_dir)), "ret").select("symbol", "date", "streak")


P8 = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"


@query("W26_standardised_surprise", sql("bars", f"SELECT symbol, date, round(CASE WHEN count(close) OVER {P8} >= 8 THEN (close - avg(close) OVER {P8}) / nullif(stddev_pop(close) OVER {P8}, 0) END, 6) AS sue FROM bars"))
def standardised_surprise(spark, sf_dir):
    return rounded(t.standardised_surprise(m.daily_bars(spark, sf_dir), "close").select("symbol", "date", "sue"), "symbol", "date")


@query("W27_rolling_quantile", sql("bars", f"SELECT symbol, date, round(CASE WHEN count(close) OVER {last(20)} >= 20 THEN quantile_cont(close, 0.9) OVER {last(20)} END, 8) AS quantile FROM bars"))
def rolling_quantile(spark, sf_dir):
    return rounded(t.rolling_quantile(m.daily_bars(spark, sf_dir), "close", 0.9, 20).select("symbol", "date", "quantile"), "symbol", "date", digits=8)


@query("W28_rolling_zscore", sql("bars", f"SELECT symbol, date, round((close - ({roll('avg', 'close', 20)})) / nullif({roll('stddev_samp', 'close', 20)}, 0), 6) AS z FROM bars"))
def rolling_zscore(spark, sf_dir):
    from ..functions.frames import zscore

    return rounded(m.daily_bars(spark, sf_dir).select("symbol", "date", zscore("close", 20).alias("z")), "symbol", "date")


@query("W29_rolling_slope", sql("bars", f", a AS (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS rn FROM bars {W}) SELECT symbol, date, round(CASE WHEN count(close) OVER {last(20)} >= 20 THEN regr_slope(close, rn) OVER {last(20)} END, 6) AS slope FROM a"))
def rolling_slope(spark, sf_dir):
    return rounded(t.rolling_slope(m.daily_bars(spark, sf_dir), "close", 20).select("symbol", "date", "slope"), "symbol", "date")


@query("W30_windows_to_arrays", sql("bars", f""", a AS (SELECT *, row_number() OVER w AS rn, lead(close, 5) OVER w AS target, list(close) OVER {last(10)} AS sample FROM bars {W})
SELECT symbol, date, len(sample) AS n_values, round(list_sum(sample), 6) AS total, round(target, 8) AS target FROM a WHERE rn >= 10 AND (rn - 10) % 5 = 0 AND target IS NOT NULL"""))
def windows_to_arrays(spark, sf_dir):
    out = t.windows_to_arrays(m.daily_bars(spark, sf_dir), "close", 10, 5, 5)
    total = F.aggregate("sample", F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("symbol", "date", F.size("sample").cast("long").alias("n_values"), F.round(total, 6).alias("total"), "target"), "symbol", "date", digits=8)


@query("W34_volatility_of_volatility", sql("rets", f", a AS (SELECT *, {roll('stddev_samp', 'ret', 20)} AS vol FROM rets) SELECT symbol, date, {r(vol='vol', vol_of_vol=roll('stddev_samp', 'vol', 20))} FROM a"))
def vol_of_vol(spark, sf_dir):
    from ..functions.frames import rolling

    rows = m.daily_bars(spark, sf_dir).withColumn("ret", change("close")).withColumn("vol", rolling("std", "ret", 20))
    return rounded(rows.select("symbol", "date", "vol", rolling("std", "vol", 20).alias("vol_of_vol")), "symbol", "date")


@query("W35_atr_simple", sql("bars", f", {TR} SELECT symbol, date, round({roll('avg', 'tr', 14)}, 6) AS atr_simple FROM tr"))
def atr_simple(spark, sf_dir):
    return rounded(t.atr_simple(m.daily_bars(spark, sf_dir)).select("symbol", "date", "atr_simple"), "symbol", "date")


@query("W36_bollinger_z", sql("bars", f""", a AS (SELECT symbol, date, close, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd FROM bars)
SELECT symbol, date, round(CASE WHEN sd IS NOT NULL THEN (close - mid) / greatest(sd, 1e-8) END, 6) AS z FROM a"""))
def bollinger_z(spark, sf_dir):
    from ..functions.frames import rolling

    rows = m.daily_bars(spark, sf_dir).withColumn("mid", rolling("mean", "close", 20)).withColumn("sd", rolling("std", "close", 20))
    return rounded(rows.select("symbol", "date", F.when(F.col("sd").isNotNull(), (F.col("close") - F.col("mid")) / F.greatest("sd", F.lit(1e-8))).alias("z")), "symbol", "date")
