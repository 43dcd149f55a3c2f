"""Queries of further features, allocation and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import div, lead, rounded
from ..operators import aggregates as a
from ..operators import allocation as al
from ..operators import features as fe
from ..operators import pair_paths
from ..operators import portfolio as p
from ..operators import reports as rp
from ..operators import signals as g
from ..operators import technical as t
from ..sources import market as m
from .micro import cdf
from .portfolio import EXPO, SCORED, SYM, per_symbol, scored
from .registry import query, sql
from .signals import PAIRS, closes, pair_table
from .technical import DD, TR, W, ema_sql, last, r, r8, roll


@query("W15_interactions", sql("rets", f""", c AS (SELECT symbol, date, ret, close / nullif(lag(close, 10) OVER w, 0) - 1 AS m, {roll('stddev_samp', 'ret', 10)} AS v, volume / nullif({roll('avg', 'volume', 10)}, 0) - 1 AS q, (high - low) / nullif(close, 0) AS rg FROM rets {W})
SELECT symbol, date, {r(momentum_x_vol='m * v', momentum_x_volume='m * q', vol_x_range='v * rg', ret_x_volume='ret * q')} FROM c"""))
def interactions(spark, sf_dir):
    return rounded(fe.interactions(m.daily_bars(spark, sf_dir)), "symbol", "date")


def _pair_corr(n: int) -> str:
    k = f"(PARTITION BY a, b ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(x) OVER {k} >= {n} THEN covar_samp(x, y) OVER {k} / nullif(stddev_samp(x) OVER {k} * stddev_samp(y) OVER {k}, 0) END"


@query("W33_correlation_change", sql("bars sectors", f", {PAIRS}, c AS (SELECT a, b, date, {_pair_corr(20)} AS s, {_pair_corr(60)} AS l FROM p) SELECT a, b, date, {r(short_corr='s', long_corr='l', change='s - l')} FROM c"))
def correlation_change(spark, sf_dir):
    return rounded(pair_paths.correlation_change(*closes(spark, sf_dir)), "a", "b", "date")


@query("W37_trend_regime", sql("rets", f""", k AS (SELECT *, CAST(row_number() OVER w AS DOUBLE) AS rn FROM rets {W}), c AS (SELECT symbol, date, {roll('stddev_samp', 'ret', 60)} AS v, CASE WHEN count(close) OVER {last(60)} >= 60 THEN abs(covar_samp(close, rn) OVER {last(60)} / nullif(stddev_samp(close) OVER {last(60)} * stddev_samp(rn) OVER {last(60)}, 0)) END AS f FROM k)
SELECT symbol, date, CASE WHEN v > 0.25 THEN 'volatile' WHEN f > 0.7 THEN 'trending' ELSE 'ranging' END AS regime FROM c"""))
def trend_regime(spark, sf_dir):
    return fe.trend_regime(m.daily_bars(spark, sf_dir))


@query("M18_rough_path", sql("rets", f""", b AS (SELECT *, volume / nullif(lag(volume) OVER w, 0) - 1 AS dq FROM rets {W}), c AS (SELECT symbol, date, ret, ret * lag(dq) OVER w AS rl, ret * ret AS r2, abs(ret) AS ar, CASE WHEN abs(ret) > 0 THEN abs(ret) * ln(abs(ret)) WHEN ret IS NOT NULL THEN 0.0 END AS al FROM b {W}),
d AS (SELECT symbol, date, {roll('sum', 'ret', 20)} AS l1, {roll('sum', 'rl', 20, 18)} AS l2, {roll('sum', 'r2', 20)} AS e, {roll('sum', 'ar', 20)} AS t, {roll('sum', 'al', 20)} AS lg FROM c)
SELECT symbol, date, {r(level_1='l1', level_2='l2', energy='e', path_entropy='CASE WHEN t > 0 THEN ln(t) - lg / t END')} FROM d"""))
def rough_path(spark, sf_dir):
    return rounded(fe.rough_path(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M30_tail_probabilities", sql("rets", f""", c AS (SELECT symbol, date, count(ret) OVER k AS n, avg(ret) OVER k AS m, stddev_pop(ret) OVER k AS s, {', '.join(f'avg(ret ** {j}) OVER k AS p{j}' for j in (2, 3, 4, 5))} FROM rets WINDOW k AS {last(60)}),
d AS (SELECT symbol, date, CASE WHEN n >= 60 THEN (p3 - 3 * m * p2 + 2 * m ** 3) / nullif(s ** 3, 0) END AS sk, CASE WHEN n >= 60 THEN (p5 - 5 * m * p4 + 10 * m * m * p3 - 10 * m ** 3 * p2 + 4 * m ** 5) / nullif(s ** 5, 0) END AS f5 FROM c), e AS (SELECT *, 1.5 - 1.25 * sk / 6 AS z FROM d)
SELECT symbol, date, {r(skew='sk', fifth='f5', p_up_tail=f"CASE WHEN z IS NOT NULL THEN 1 - ({cdf('z')}) END")} FROM e"""))
def tail_probabilities(spark, sf_dir):
    return rounded(fe.tail_probabilities(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M23_histogram_entropy", sql("rets", f""", c AS (SELECT symbol, date, list(ret) FILTER (ret IS NOT NULL) OVER {last(30)} AS x FROM rets), d AS (SELECT symbol, date, x, list_min(x) AS lo, list_max(x) AS hi FROM c WHERE len(x) = 30), b AS (SELECT symbol, date, lo, hi, list_transform(x, lambda v: least(floor((v - lo) / nullif(hi - lo, 0) * 6), 5)) AS b FROM d)
SELECT symbol, date, round(CASE WHEN hi > lo THEN {' + '.join(f"CASE WHEN len(list_filter(b, lambda v: v = {k})) > 0 THEN -(len(list_filter(b, lambda v: v = {k})) / 30.0) * log2(len(list_filter(b, lambda v: v = {k})) / 30.0) ELSE 0.0 END" for k in range(6))} ELSE 0.0 END, 6) AS entropy FROM b"""))
def histogram_entropy(spark, sf_dir):
    return rounded(fe.histogram_entropy(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M38_variance_time_hurst", sql("rets", f""", k AS (SELECT symbol, ret, row_number() OVER w - 1 AS rn FROM rets WHERE ret IS NOT NULL {W}), b AS (SELECT symbol, m, avg(ret) AS b FROM k, (VALUES (1), (2), (4), (8)) AS s(m) GROUP BY symbol, m, rn // m HAVING count(*) = m), v AS (SELECT symbol, m, var_pop(b) AS v FROM b GROUP BY symbol, m HAVING var_pop(b) > 0)
SELECT symbol, round(1 + regr_slope(ln(v), ln(m)) / 2, 6) AS hurst FROM v GROUP BY symbol HAVING count(*) >= 3"""))
def variance_time_hurst(spark, sf_dir):
    return rounded(fe.variance_time_hurst(m.daily_bars(spark, sf_dir)), "symbol")


@query("M28_tail_dependence", sql("bars sectors", f""", {PAIRS}, s AS (SELECT a, b, sign(x - lag(x) OVER k) * sign(y - lag(y) OVER k) AS s FROM p WINDOW k AS (PARTITION BY a, b ORDER BY date)), u AS (SELECT a, b, avg(s) AS tau, count(*) AS n FROM s WHERE s IS NOT NULL GROUP BY a, b)
SELECT a, b, n, {r(tau='tau', lower_tail='CASE WHEN tau > 0.01 AND tau < 0.99 THEN 2.0 ** (-1 / (2 * tau / (1 - tau))) ELSE 0.0 END', upper_tail='CASE WHEN tau > 0 AND tau < 0.99 THEN 2 - 2.0 ** (1 - tau) ELSE 0.0 END')} FROM u"""))
def tail_dependence(spark, sf_dir):
    return rounded(fe.tail_dependence(m.daily_bars(spark, sf_dir).join(m.sectors(spark, sf_dir), "symbol"), "industry", "close"), "a", "b", "n")


OPT = f"od AS (SELECT symbol, date, sum(CASE WHEN l_returnflag = 'R' THEN quantity ELSE 0.0 END) AS pv, sum(CASE WHEN l_returnflag = 'A' THEN quantity ELSE 0.0 END) AS cv, avg(l_tax) - avg(l_discount) AS sk FROM ticks WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2), oe AS (SELECT *, pv / nullif(cv, 0) AS pc, pv + cv AS t FROM od), oz AS (SELECT *, (t - ({roll('avg', 't', 20)})) / nullif({roll('stddev_samp', 't', 20)}, 0) AS vz FROM oe)"


@query("R27_options_signal", sql("ticks", f""", {OPT}, c AS (SELECT *, {roll('avg', 'pc', 10, 3)} AS pm, round({roll('avg', 'sk', 10)} + {roll('stddev_samp', 'sk', 10)}, 9) AS sm FROM oz)
SELECT symbol, date, CAST(sign(CASE WHEN pc > 1.2 * pm THEN 1 WHEN pc < 0.8 * pm THEN -1 ELSE 0 END + CASE WHEN round(sk, 9) > sm THEN -1 ELSE 0 END + CASE WHEN vz > 2 THEN 1 ELSE 0 END) AS INTEGER) AS signal FROM c""".replace("CASE WHEN count(sk) OVER", "(CASE WHEN count(sk) OVER").replace("END + (CASE", "END) + (CASE").replace("END, 9) AS sm", "END), 9) AS sm")))
def options_signal(spark, sf_dir):
    return fe.options_signal(a.options_rollup(m.ticks(spark, sf_dir)))


SOC = "sd AS (SELECT symbol, CAST(ts AS DATE) AS date, avg(sentiment) AS sentiment, sum(volume) AS volume FROM mentions GROUP BY 1, 2)"


@query("R30_social_signal", sql("mentions", f""", {SOC}, c AS (SELECT *, sentiment - lag(sentiment) OVER w AS d FROM sd {W}), z AS (SELECT symbol, date, (d - ({roll('avg', 'd', 5, 3)})) / nullif({roll('stddev_samp', 'd', 5, 3)}, 0) AS sz, (volume - ({roll('avg', 'volume', 5, 3)})) / nullif({roll('stddev_samp', 'volume', 5, 3)}, 0) AS vz FROM c)
SELECT symbol, date, {r(sentiment_z='sz', volume_z='vz')}, CASE WHEN sz > 1 AND vz > 1 THEN -1 WHEN sz < -1 AND vz > 1 THEN 1 ELSE 0 END AS signal FROM z"""))
def social_signal(spark, sf_dir):
    return rounded(fe.social_signal(a.daily_sentiment(m.mentions(spark, sf_dir)).select("symbol", "date", "sentiment", "volume")), "symbol", "date", "signal")


@query("R32_source_blend", sql("bars disclosures articles", """, d AS (SELECT symbol, date, sum(CASE kind WHEN 'buy' THEN amount WHEN 'sell' THEN -amount ELSE 0.0 END) / nullif(sum(amount), 0) AS v FROM disclosures GROUP BY 1, 2), n AS (SELECT symbol, date, avg(least(greatest((n_chars - 2000) / 2000.0, -1.0), 1.0)) AS v FROM articles GROUP BY 1, 2)
SELECT b.symbol, b.date, round((coalesce(d.v * 2.0, 0.0) + coalesce(n.v * 1.0, 0.0)) / nullif(CASE WHEN d.v IS NOT NULL THEN 2.0 ELSE 0.0 END + CASE WHEN n.v IS NOT NULL THEN 1.0 ELSE 0.0 END, 0), 6) AS blend FROM bars b LEFT JOIN d ON b.symbol = d.symbol AND b.date = d.date LEFT JOIN n ON b.symbol = n.symbol AND b.date = n.date"""))
def source_blend(spark, sf_dir):
    signed = F.when(F.col("kind") == "buy", F.col("amount")).when(F.col("kind") == "sell", -F.col("amount")).otherwise(0.0)
    d = m.disclosures(spark, sf_dir).groupBy("symbol", "date").agg(div(F.sum(signed), F.sum("amount")).alias("value"))
    n = a.article_features(m.articles(spark, sf_dir)).select("symbol", "date", F.col("mean").alias("value"))
    return rounded(fe.source_blend({"filings": (d, 2.0), "news": (n, 1.0)}, m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("J8_drift_window", sql("rets", """, e AS (SELECT symbol, date, ret AS surprise FROM rets WHERE abs(ret) > 0.5) SELECT b.symbol, b.date, round(arg_max(e.surprise, e.date), 6) AS surprise, max(e.date) AS event_date FROM rets b JOIN e ON b.symbol = e.symbol AND b.date > e.date AND b.date <= e.date + 20 GROUP BY b.symbol, b.date"""))
def drift_window(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir))
    return rounded(fe.drift_window(rows, rows.where("abs(ret) > 0.5").select("symbol", "date", F.col("ret").alias("surprise")), 20), "symbol", "date")


@query("A24_aggregate_fundamentals", sql("fundamentals", f"SELECT count(*) AS n, {r(mean_price='avg(price)', margin='sum(ebit) / nullif(sum(revenue), 0)', leverage='sum(debt) / nullif(sum(ebit), 0)')} FROM fundamentals"))
def aggregate_fundamentals(spark, sf_dir):
    out = m.fundamentals(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("price").alias("mean_price"), div(F.sum("ebit"), F.sum("revenue")).alias("margin"), div(F.sum("debt"), F.sum("ebit")).alias("leverage"))
    return rounded(out, "n")


@query("V23_residual_targets", sql("bars sectors", f""", f AS (SELECT symbol, date, sector, lead(close, 5) OVER w / nullif(close, 0) - 1 AS f FROM bars JOIN sectors USING (symbol) {W}), k AS (SELECT * FROM f WHERE f IS NOT NULL)
SELECT symbol, date, round(f - 0.5 * avg(f) OVER (PARTITION BY date) - 0.5 * avg(f) OVER (PARTITION BY date, sector), 6) AS target FROM k"""))
def residual_targets(spark, sf_dir):
    return rounded(fe.residual_targets(m.daily_bars(spark, sf_dir).join(m.sectors(spark, sf_dir), "symbol"), "sector"), "symbol", "date")


@query("G8_position_sizes", sql("bars", f", {TR}, e AS (SELECT symbol, date, {ema_sql('tr', 14)} AS atr FROM tr) SELECT symbol, date, round(10000.0 / nullif(atr * 2.0, 0), 4) AS size FROM e"))
def position_sizes(spark, sf_dir):
    out = al.position_sizes(t.atr(m.daily_bars(spark, sf_dir)), 1e6, 0.01, 2.0)
    return out.select("symbol", "date", F.round("size", 4).alias("size"))


@query("V27_project", sql("rets", """, b AS (SELECT symbol, date, least(greatest(ret, -0.2), 0.2) AS w FROM rets WHERE ret IS NOT NULL), s AS (SELECT *, sum(abs(w)) OVER d AS g FROM b WINDOW d AS (PARTITION BY date)), c AS (SELECT symbol, date, CASE WHEN g > 0.5 THEN w * 0.5 / g ELSE w END AS w FROM s)
SELECT symbol, date, round(least(greatest(w - avg(w) OVER (PARTITION BY date), -0.2), 0.2), 8) AS projected FROM c"""))
def project(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).where("ret is not null").select("symbol", "date", F.col("ret").alias("weight"))
    return rounded(al.project(rows, 0.2, 0.5).select("symbol", "date", "projected"), "symbol", "date", digits=8)


@query("V28_portfolio_returns", sql("rets", f", v AS (SELECT symbol, date, ret, {roll('var_samp', 'ret', 20)} AS v FROM rets), i AS (SELECT symbol, date, ret, 1 / v AS i FROM v WHERE v > 0), w AS (SELECT *, i / nullif(sum(i) OVER (PARTITION BY date), 0) AS weight FROM i) SELECT date, {r(ret='sum(weight * ret)', gross='sum(abs(weight))')} FROM w WHERE ret IS NOT NULL GROUP BY date"))
def portfolio_returns(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir)
    return rounded(al.portfolio_returns(p.inverse_variance(bars), m.with_returns(bars)), "date")


@query("V30_correlation_summary", sql("bars sectors", f", {PAIRS} SELECT count(*) AS n, {r(average='avg(abs(correlation))', largest='max(abs(correlation))', share_high='avg(CAST(abs(correlation) > 0.5 AS DOUBLE))')} FROM ps WHERE correlation IS NOT NULL"))
def correlation_summary(spark, sf_dir):
    return rounded(al.correlation_summary(pair_table(spark, sf_dir)), "n")


@query("V43_diversification", sql("ticks", f", {EXPO}, s AS (SELECT abs(exposure) / nullif(sum(abs(exposure)) OVER (), 0) AS s FROM bk) SELECT count(*) AS n, {r(effective_n='1 / nullif(sum(s * s), 0)', largest='max(s)')} FROM s"))
def diversification(spark, sf_dir):
    rows = m.ticks(spark, sf_dir).groupBy("symbol").agg(F.sum(F.col("price") * F.col("quantity")).alias("exposure"))
    return rounded(al.diversification(rows), "n")


@query("V36_value_weights", sql("fundamentals", ", s AS (SELECT symbol, ebit / nullif(revenue, 0) AS score FROM fundamentals), w AS (SELECT symbol, least(score / sum(score) OVER (), 0.2) AS w FROM s WHERE score > 0) SELECT symbol, round(w / nullif(sum(w) OVER (), 0), 6) AS weight FROM w"))
def value_weights(spark, sf_dir):
    return rounded(al.value_weights(m.fundamentals(spark, sf_dir).select("symbol", div("ebit", "revenue").alias("score")), 0.2), "symbol")


@query("V39_slippage", sql("ticks bars", f"SELECT l_orderkey, l_linenumber, l_partkey, quantity, round(0.00137 / 2 + 0.1 * sqrt(least(quantity / nullif(volume, 0), 1.0)), 6) AS slippage_rate, round(greatest(price * quantity * 0.0005, 1.0), 6) AS commission FROM ticks JOIN bars USING (symbol, date)"))
def slippage(spark, sf_dir):
    fills = m.ticks(spark, sf_dir).join(m.daily_bars(spark, sf_dir).select("symbol", "date", F.col("volume").alias("bar_volume")), ["symbol", "date"])
    return rounded(al.slippage(fills, spread=0.00137).select("place.l_orderkey", "place.l_linenumber", "place.l_partkey", "quantity", div("slippage", "price").alias("slippage_rate"), "commission"), "l_orderkey", "l_linenumber", "l_partkey", "quantity")


@query("G18_learned_weights", sql("rets", f""", f AS (SELECT symbol, date, ret, volume, close, lead(ret) OVER w AS nxt FROM rets {W}), l AS (SELECT 'own' AS name, ret AS signal, nxt FROM f WHERE ret IS NOT NULL AND nxt IS NOT NULL UNION ALL SELECT 'reversal', -ret, nxt FROM f WHERE ret IS NOT NULL AND nxt IS NOT NULL UNION ALL SELECT 'volume', volume, nxt FROM f WHERE nxt IS NOT NULL),
c AS (SELECT name, covar_samp(signal, nxt) / nullif(stddev_samp(signal) * stddev_samp(nxt), 0) AS c FROM l GROUP BY name) SELECT name, {r(correlation='c', weight='coalesce(greatest(coalesce(c, 0.0), 0.0) / nullif(sum(greatest(coalesce(c, 0.0), 0.0)) OVER (), 0), 0.0)')} FROM c"""))
def learned_weights(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).withColumn("nxt", lead("ret")).where("nxt is not null")
    part = lambda name, c: rows.where(F.col("ret").isNotNull() if name != "volume" else F.lit(True)).select(F.lit(name).alias("name"), c.alias("signal"), F.col("nxt").alias("ret"))
    return rounded(al.learned_weights(part("own", F.col("ret")).unionByName(part("reversal", -F.col("ret"))).unionByName(part("volume", F.col("volume")))), "name")


@query("G23_select_trades", sql("bars", f", {SCORED}, k AS (SELECT date, symbol, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rank FROM scored WHERE score >= 0.6), s AS (SELECT * FROM k WHERE rank <= 3) SELECT date, symbol, CAST(rank AS INTEGER) AS rank, round(score / nullif(sum(score) OVER (PARTITION BY date), 0), 6) AS weight FROM s"))
def select_trades(spark, sf_dir):
    return rounded(al.select_trades(scored(spark, sf_dir), 0.6, 3), "date", "symbol", "rank")


@query("G28_momentum_tilt", sql("bars", f", {SCORED}, d AS (SELECT symbol, date, momentum - avg(momentum) OVER (PARTITION BY date) AS d FROM scored WHERE momentum IS NOT NULL), x AS (SELECT symbol, date, 1 + 0.5 * coalesce(d / nullif(max(abs(d)) OVER (PARTITION BY date), 0), 0.0) AS x FROM d) SELECT symbol, date, round(x / nullif(sum(x) OVER (PARTITION BY date), 0), 6) AS weight FROM x"))
def momentum_tilt(spark, sf_dir):
    return rounded(al.momentum_tilt(scored(spark, sf_dir), 0.5), "symbol", "date")


@query("G29_two_model_blend", sql("bars", """, f AS (SELECT symbol, date, volume / 100 AS p FROM bars WHERE day(date) % 2 = 0), s AS (SELECT symbol, date, close / (1 + close) AS p FROM bars WHERE day(date) % 3 = 0)
SELECT coalesce(f.symbol, s.symbol) AS symbol, coalesce(f.date, s.date) AS date, round(CASE WHEN f.p IS NOT NULL AND s.p IS NOT NULL THEN 0.7 * f.p + (1 - 0.7) * s.p ELSE coalesce(f.p, s.p) END, 6) AS p, CASE WHEN f.p IS NOT NULL AND s.p IS NOT NULL THEN 'blended' WHEN f.p IS NOT NULL THEN 'first' ELSE 'second' END AS source FROM f FULL JOIN s ON f.symbol = s.symbol AND f.date = s.date"""))
def two_model_blend(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir)
    first = bars.where(F.dayofmonth("date") % 2 == 0).select("symbol", "date", (F.col("volume") / 100).alias("p"))
    second = bars.where(F.dayofmonth("date") % 3 == 0).select("symbol", "date", (F.col("close") / (1 + F.col("close"))).alias("p"))
    return rounded(al.two_model_blend(first, second, 0.7), "symbol", "date")


@query("G26_exposure_multiplier", sql("rets", f", {DD} SELECT symbol, date, CASE WHEN -drawdown >= 0.5 THEN 'breaker' WHEN -drawdown >= 0.3 THEN 'critical' WHEN -drawdown >= 0.1 THEN 'warning' ELSE 'normal' END AS state, round(least(greatest(1 - (-drawdown - 0.1) / 0.4, 0.0), 1.0), 6) AS exposure FROM dd"))
def exposure_multiplier(spark, sf_dir):
    return rounded(al.exposure_multiplier(t.drawdown(m.with_returns(m.daily_bars(spark, sf_dir)))), "symbol", "date")


STATS = f"{SYM}, st AS (SELECT symbol, avg(ret) AS mean, stddev_samp(ret) AS std, avg(CAST(ret > 0 AS DOUBLE)) AS win FROM sym GROUP BY symbol)"


def stats(spark, sf_dir):
    return per_symbol(spark, sf_dir).groupBy("symbol").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.avg((F.col("ret") > 0).cast("double")).alias("win"))


@query("V12_gate", sql("rets", f", {STATS}, j AS (SELECT symbol, CAST(mean >= 0.3 AS INTEGER) + CAST(std <= 1.5 AS INTEGER) + CAST(abs(win) <= 0.51 AS INTEGER) AS p FROM st) SELECT symbol, CAST(p AS BIGINT) AS passes, CAST(3 AS BIGINT) AS checks, CASE WHEN p = 3 THEN 'pass' WHEN p * 2 >= 3 THEN 'watch' ELSE 'fail' END AS verdict FROM j"))
def gate(spark, sf_dir):
    return rp.gate(stats(spark, sf_dir), "symbol", {"mean": ("higher", 0.3), "std": ("lower", 1.5), "win": ("abs_lower", 0.51)})


@query("V13_fail_reasons", sql("rets", f", {STATS} SELECT symbol, concat_ws(',', CASE WHEN NOT coalesce(mean > 0.3, FALSE) THEN 'mean' END, CASE WHEN NOT coalesce(std < 1.5, FALSE) THEN 'std' END, CASE WHEN NOT coalesce(win > 0.5, FALSE) THEN 'win' END) AS reasons FROM st"))
def fail_reasons(spark, sf_dir):
    return rp.fail_reasons(stats(spark, sf_dir), "symbol", {"mean": F.col("mean") > 0.3, "std": F.col("std") < 1.5, "win": F.col("win") > 0.5})


@query("V17_random_windows", sql("rets", """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d FROM (SELECT DISTINCT date FROM rets)), p AS (SELECT date, s AS start FROM d, (VALUES (10), (200), (450)) AS q(s) WHERE d >= s AND d < s + 100), k AS (SELECT start, symbol, avg(ret) AS mean FROM rets JOIN p USING (date) WHERE ret IS NOT NULL GROUP BY 1, 2)
SELECT CAST(start AS INTEGER) AS start, first(symbol ORDER BY mean DESC, symbol) AS winner, round(max(mean), 6) AS best, count(*) AS n FROM k GROUP BY start"""))
def random_windows(spark, sf_dir):
    return rounded(rp.random_windows(m.with_returns(m.daily_bars(spark, sf_dir)), [10, 200, 450], 100), "start", "winner")


@query("V17_seeded_windows", sql("rets", """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM rets)), s AS (SELECT d AS start FROM d WHERE n > 100 AND d + 100 <= n ORDER BY md5(concat('7|', d)) LIMIT 20), p AS (SELECT date, start FROM d JOIN s ON d >= start AND d < start + 100), k AS (SELECT start, symbol, avg(ret) AS mean FROM rets JOIN p USING (date) WHERE ret IS NOT NULL GROUP BY 1, 2)
SELECT CAST(start AS INTEGER) AS start, first(symbol ORDER BY mean DESC, symbol) AS winner, round(max(mean), 6) AS best, count(*) AS n FROM k GROUP BY start"""))
def seeded_windows(spark, sf_dir):
    """As V17_random_windows, with starts drawn over the whole calendar."""
    rets = m.with_returns(m.daily_bars(spark, sf_dir))
    return rounded(rp.random_windows(rets, rp.window_starts(rets, 20, 100, 7), 100), "start", "winner")


@query("V33_alerts", sql("rets", f", {STATS}, l AS (SELECT symbol, 'mean' AS metric, mean AS value FROM st UNION ALL SELECT symbol, 'std', std FROM st UNION ALL SELECT symbol, 'win', win FROM st) SELECT symbol, metric, round(value, 6) AS value, level FROM l JOIN (VALUES ('mean', 0.3, 'info'), ('std', 1.5, 'warning')) AS q(metric, lim, level) USING (metric) WHERE value > lim"))
def alerts(spark, sf_dir):
    rules = spark.createDataFrame([("mean", 0.3, "info"), ("std", 1.5, "warning")], "metric string, limit double, level string")
    return rounded(rp.alerts(stats(spark, sf_dir), "symbol", rules), "symbol", "metric")


@query("V34_provider_choice", """WITH c AS (SELECT o_custkey AS key, o_orderpriority AS provider, 1.0 / (1 + o_orderkey % 5) AS f, (o_orderkey % 10) / 10.0 AS c, CAST(o_orderkey % 1500 AS DOUBLE) AS l, (o_orderkey % 4) / 4.0 AS r, o_orderkey FROM orders), s AS (SELECT key, provider, round(0.3 * f + 0.3 * c + 0.2 * (1 - least(l / 1000.0, 1.0)) + 0.2 * r, 9) AS score, o_orderkey FROM c)
SELECT key, first(provider ORDER BY score DESC, provider) AS provider, round(max(score), 6) AS score FROM s GROUP BY key""")
def provider_choice(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = m.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("provider"), (1.0 / (1 + k % 5)).alias("freshness"), ((k % 10) / 10.0).alias("completeness"), (k % 1500).cast("double").alias("latency_ms"), ((k % 4) / 4.0).alias("reliability"))
    return rounded(rp.provider_choice(rows), "key", "provider")


@query("V49_median_parameters", sql("rets", f", {STATS}, l AS (SELECT 'mean' AS parameter, mean AS v FROM st UNION ALL SELECT 'std', std FROM st) SELECT parameter, {r(median='median(v)', std='stddev_samp(v)')} FROM l GROUP BY parameter"))
def median_parameters(spark, sf_dir):
    return rounded(rp.median_parameters(stats(spark, sf_dir), ["mean", "std"]), "parameter")


@query("V51_signal_returns", sql("bars", f", {SCORED}, s AS (SELECT symbol, date, tanh(momentum) AS s, forward_return AS f FROM scored WHERE momentum IS NOT NULL), b AS (SELECT *, coalesce(lag(s) OVER w, 0.0) AS b FROM s {W}) SELECT symbol, date, round(s * f - 0.0005 * abs(s - b), 6) AS net FROM b WHERE f IS NOT NULL"))
def signal_returns(spark, sf_dir):
    return rounded(rp.signal_returns(scored(spark, sf_dir).where("momentum is not null").withColumn("prediction", F.col("momentum")), 0.0005), "symbol", "date")


@query("V53_compare_runs", sql("rets", f", {SYM}, x AS (SELECT symbol, avg(ret) AS mean, stddev_samp(ret) AS std FROM sym WHERE year(date) <= 1997 GROUP BY symbol), y AS (SELECT symbol, avg(ret) AS mean, stddev_samp(ret) AS std FROM sym WHERE year(date) > 1997 GROUP BY symbol) SELECT symbol, {r(d_mean='y.mean - x.mean', d_std='y.std - x.std')} FROM x JOIN y USING (symbol)"))
def compare_runs(spark, sf_dir):
    rows = per_symbol(spark, sf_dir)
    part = lambda c: rows.where(c).groupBy("symbol").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"))
    return rounded(rp.compare_runs(part(F.year("date") <= 1997), part(F.year("date") > 1997), "symbol", ["mean", "std"]), "symbol")


@query("C10_store_quality", sql("bars disclosures", """, s AS (SELECT count(DISTINCT symbol) AS s, count(DISTINCT date) AS d FROM bars) SELECT domain, present, round(present / nullif(s * d, 0), 6) AS completeness FROM (SELECT 'bars' AS domain, count(*) AS present FROM bars UNION ALL SELECT 'filings', count(*) FROM (SELECT DISTINCT symbol, date FROM disclosures)), s"""))
def store_quality(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir).select("symbol", "date")
    present = bars.withColumn("domain", F.lit("bars")).unionByName(m.disclosures(spark, sf_dir).select("symbol", "date").withColumn("domain", F.lit("filings")))
    return rounded(rp.store_quality(present, bars, bars, ["bars", "filings"]), "domain", "present")
