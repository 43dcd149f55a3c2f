"""Queries of path measures on thinned rows, dependence on peers, and groups of correlated positions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import across, div, rounded
from ..operators import features as fe
from ..operators import paths as p
from ..sources import market as m
from .recursions import recursive
from .registry import ORACLES, query, sql
from .technical import W, r, r8, roll

KEYS = ("symbol", "date")


@query("M25_rescaled_range", sql("bars", f""", a AS (SELECT symbol, date, row_number() OVER w - 1 AS p, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS x FROM bars {W}),
b AS (SELECT symbol, date, w, x[b * w + 1:(b + 1) * w] AS s FROM a, range(10, 26) AS t(w), range(0, 10) AS u(b) WHERE p >= 100 AND (p - 100) % 10 = 0 AND (b + 1) * w <= 100),
c AS (SELECT symbol, date, w, list_transform(range(1, w + 1), lambda j: list_sum(s[1:j]) - j * list_avg(s)) AS c, list_aggregate(s, 'stddev_samp') AS sd FROM b),
k AS (SELECT symbol, date, ln(w) AS x, ln(avg((list_max(c) - list_min(c)) / sd)) AS y FROM c WHERE sd > 1e-9 GROUP BY symbol, date, w),
f AS (SELECT symbol, date, regr_slope(y, x) AS h, covar_samp(x, y) * covar_samp(x, y) / nullif(var_samp(x) * var_samp(y), 0) AS f FROM k GROUP BY symbol, date HAVING count(*) >= 3)
SELECT symbol, date, {r(hurst='last_value(h IGNORE NULLS) OVER v', fit='last_value(f IGNORE NULLS) OVER v')} FROM bars LEFT JOIN f USING (symbol, date) WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def rescaled_range(spark, sf_dir):
    return rounded(p.rescaled_range(m.daily_bars(spark, sf_dir), "close"), *KEYS)


@query("M27_distribution_shift", sql("bars", f""", a AS (SELECT symbol, date, row_number() OVER w - 1 AS p, list(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 79 PRECEDING AND CURRENT ROW) AS x FROM bars {W}),
o AS (SELECT symbol, date, x[1:60] AS old, list_sort(x[1:60]) AS so, list_sort(x[61:80]) AS sn FROM a WHERE p >= 79 AND (p - 79) % 40 = 0),
e AS (SELECT symbol, date, old, k, list_avg(list_transform(range(1, 61), lambda i: abs(so[i] - sn[(i + 2) // 3]))) AS distance FROM o, range(1, 101) AS t(k)),
h AS (SELECT symbol, date, distance, list_transform(list_sort(list_transform(range(1, 61), lambda i: {{'h': md5(concat_ws(':', symbol, date, k, i)), 'v': old[i]}})), lambda s: s.v) AS v FROM e),
d AS (SELECT symbol, date, distance, list_sort(v[1:30]) AS a, list_sort(v[31:60]) AS b FROM h),
g AS (SELECT symbol, date, any_value(distance) AS distance, avg(list_avg(list_transform(range(1, 31), lambda i: abs(a[i] - b[i])))) AS mn, stddev_pop(list_avg(list_transform(range(1, 31), lambda i: abs(a[i] - b[i])))) AS sd FROM d GROUP BY symbol, date),
z AS (SELECT *, CASE WHEN sd < 1e-10 THEN 0.0 ELSE (distance - mn) / sd END AS z FROM g)
SELECT symbol, date, {r(distance='distance', baseline_mean='mn', baseline_std='sd', z='z')}, CASE WHEN z > 3 THEN 'severe' WHEN z > 2 THEN 'significant' WHEN z > 1 THEN 'mild' ELSE 'normal' END AS shift FROM z"""))
def distribution_shift(spark, sf_dir):
    return rounded(p.distribution_shift(m.daily_bars(spark, sf_dir), "close", step=40), *KEYS)


@query("M36_path_signals", f"""WITH h AS ({ORACLES['M25_rescaled_range']}), d AS ({ORACLES['M27_distribution_shift']}), j AS (SELECT h.*, last_value(z IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zz FROM h LEFT JOIN d USING (symbol, date))
SELECT symbol, date, CASE WHEN hurst IS NULL THEN NULL WHEN hurst < 0.35 THEN 'strongly reverting' WHEN hurst < 0.45 THEN 'reverting' WHEN hurst < 0.55 THEN 'random walk' WHEN hurst < 0.65 THEN 'trending' ELSE 'strongly trending' END AS persistence,
coalesce(zz > 2, false) AS reduce, {r(signal='2 * (hurst - 0.5) * fit', confidence='CASE WHEN zz IS NULL THEN 1.0::DOUBLE WHEN zz > 2 THEN greatest(0.0, 1 - zz / 5) ELSE least(1.0, 1 - zz / 3) END')} FROM j""")
def path_signals(spark, sf_dir):
    """Of the measures as they are reported, to 6 digits."""
    return rounded(p.path_signals(rescaled_range(spark, sf_dir), distribution_shift(spark, sf_dir)), *KEYS, "persistence", "reduce")


@query("R5_dependence", sql("rets sectors", f""", s AS (SELECT symbol, date, ret, (sum(ret) OVER k - ret) / nullif(count(ret) OVER k - 1, 0) AS peer, (close - open) / nullif(open, 0) AS tone, volume / 1000 AS crowd FROM rets JOIN sectors USING (symbol) WINDOW k AS (PARTITION BY industry, date)),
a AS (SELECT *, row_number() OVER w - 1 AS p, list({{'x': coalesce(ret, 0.0), 'y': coalesce(peer, 0.0), 'p': coalesce(ret, 0.0) + 0.2 * coalesce(tone, 0.0)}}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS w FROM s {W}),
t AS (SELECT symbol, date, w, abs(crowd) AS crowd FROM a WHERE p >= 60 AND ((p - 60) % 21 = 0 OR coalesce(abs(ret) > 2, false))),
k AS (SELECT symbol, date, sum(sign(w[i].x - w[j].x) * sign(w[i].y - w[j].y)) / 1770 AS tau FROM t, range(2, 61) AS u(i), range(1, 60) AS v(j) WHERE j < i GROUP BY symbol, date),
c AS (SELECT symbol, date, crowd, tau, list_max(list_transform(w, lambda v: v.x)) > list_min(list_transform(w, lambda v: v.x)) AND list_max(list_transform(w, lambda v: v.y)) > list_min(list_transform(w, lambda v: v.y)) AS spread,
CASE WHEN tau > 1e-9 THEN power(2.0, -(1 - tau) / (2 * tau)) ELSE 0.0 END AS lo, CASE WHEN tau > 1e-9 THEN 2 - power(2.0, 1 - tau) ELSE 0.0 END AS hi, list_sort(list_transform(w[1:30], lambda v: v.p)) AS f, list_sort(list_transform(w[31:60], lambda v: v.p)) AS g FROM t JOIN k USING (symbol, date)),
x AS (SELECT symbol, date, CASE WHEN spread THEN CASE WHEN tau <= 1e-9 THEN 0.0 WHEN lo >= hi THEN 1.0 ELSE 2.0 END END AS code, CASE WHEN spread THEN lo END AS lo, CASE WHEN spread THEN hi END AS hi, list_avg(list_transform(range(1, 31), lambda i: abs(f[i] - g[i]))) AS d, crowd FROM c)
SELECT symbol, date, {r(**{n: f'CAST(coalesce(last_value({c} IGNORE NULLS) OVER v, 0.0) AS DOUBLE)' for n, c in (('copula_code', 'code'), ('lower_tail', 'lo'), ('upper_tail', 'hi'), ('transport_distance', 'd'), ('crowding', 'x.crowd'))})} FROM s LEFT JOIN x USING (symbol, date) WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def dependence(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).join(m.sectors(spark, sf_dir), "symbol")
    w = across("industry", "date")
    rows = rows.withColumns({"peer": div(F.sum("ret").over(w) - F.col("ret"), F.count("ret").over(w) - 1), "tone": div(F.col("close") - F.col("open"), "open"), "crowd": F.col("volume") / 1000})
    return rounded(p.dependence(rows, event=F.abs("ret") > 2), *KEYS)


GROUPS = """x AS (SELECT symbol, date, industry, ret FROM rets JOIN sectors USING (symbol) WHERE ret IS NOT NULL), pr AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, covar_samp(a.ret, b.ret) / nullif(stddev_samp(a.ret) * stddev_samp(b.ret), 0) AS c FROM x a JOIN x b ON a.industry = b.industry AND a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2),
ed AS (SELECT a, b FROM pr WHERE n >= 20 AND abs(c) >= 0.05), nd AS (SELECT a FROM ed UNION SELECT b FROM ed), ls AS (SELECT a, row_number() OVER (ORDER BY a) AS k, (SELECT coalesce(list(b ORDER BY b), []) FROM ed WHERE ed.a = nd.a) AS bs FROM nd),
gr AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS s, CAST([] AS BIGINT[]) AS n UNION ALL SELECT ls.k, CASE WHEN list_contains(s, a) THEN s ELSE list_concat(s, list_filter(list_concat([a], bs), lambda v: NOT list_contains(s, v))) END,
CASE WHEN list_contains(s, a) THEN n ELSE list_concat(n, list_transform(list_filter(list_concat([a], bs), lambda v: NOT list_contains(s, v)), lambda v: a)) END FROM gr JOIN ls ON ls.k = gr.k + 1),
gp AS (SELECT unnest(s) AS symbol, unnest(n) AS anchor FROM (SELECT s, n FROM gr ORDER BY k DESC LIMIT 1))"""


def groups(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).join(m.sectors(spark, sf_dir), "symbol").withColumnRenamed("industry", "cluster")
    return p.correlated_groups(rows, 0.05)


@query("V41_correlated_groups", recursive("rets sectors", f", {GROUPS} SELECT symbol, anchor FROM gp"))
def correlated_groups(spark, sf_dir):
    return groups(spark, sf_dir)


@query("V41_group_limits", recursive("rets sectors", f""", {GROUPS}, ps AS (SELECT symbol, (CASE WHEN symbol % 3 = 0 THEN -1 ELSE 1 END) * last(close ORDER BY date) AS value FROM bars GROUP BY symbol),
mt AS (SELECT ps.symbol, value, coalesce(anchor, ps.symbol) AS anchor FROM ps LEFT JOIN gp ON ps.symbol = gp.symbol), sh AS (SELECT *, count(*) OVER (PARTITION BY anchor) AS members, sum(abs(value)) OVER (PARTITION BY anchor) / (SELECT sum(abs(value)) FROM mt) AS share FROM mt)
SELECT symbol, anchor, members, share > 0.03 AS breach, {r8(value='value', share='share', target='CASE WHEN share > 0.03 THEN value * 0.03 / share ELSE value END')} FROM sh"""))
def group_limits(spark, sf_dir):
    last = m.daily_bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    positions = last.select("symbol", (F.when(F.col("symbol") % 3 == 0, -1).otherwise(1) * F.col("close")).alias("value"))
    return rounded(p.group_limits(positions, groups(spark, sf_dir), 0.03), "symbol", "anchor", "members", "breach", digits=8)


L252 = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"


@query("W15_all_interactions", sql("rets articles", f""", x AS ({ORACLES['W3_rsi']}), y AS ({ORACLES['W8_adx']}), z AS ({ORACLES['W5_bollinger']}), tn AS (SELECT symbol, date, avg((n_chars % 200) / 100.0 - 1) AS tone FROM articles GROUP BY symbol, date),
b AS (SELECT symbol, date, ret, close / nullif(lag(close, 63) OVER w, 0) - 1 AS mom, {roll('stddev_samp', 'ret', 21)} AS vol, volume / nullif({roll('avg', 'volume', 20)}, 0) - 1 AS vr, close / nullif(max(close) OVER {L252}, 0) - 1 AS dd, ({roll('stddev_samp', 'ret', 20)}) * sqrt(252.0) AS rv,
({roll('avg', 'close', 50)}) / nullif({roll('avg', 'close', 200)}, 0) - 1 AS sx, sign(({roll('avg', 'close', 20)}) / nullif({roll('avg', 'close', 50)}, 0) - 1) AS tr, (close - ({roll('avg', 'close', 20)})) / nullif({roll('stddev_samp', 'close', 20)}, 0) AS zs FROM rets {W}),
j AS (SELECT b.*, (x.rsi - 50) / 50 AS ri, y.adx / 100 AS ad, z.bb_position - 0.5 AS bp, coalesce(tn.tone, 0.0) AS tone, CASE WHEN zs > 2 THEN -1 WHEN zs < -2 THEN 1 ELSE 0 END AS mr FROM b JOIN x USING (symbol, date) JOIN y USING (symbol, date) JOIN z USING (symbol, date) LEFT JOIN tn ON b.symbol = tn.symbol AND b.date = tn.date)
SELECT symbol, date, {r(tone_x_momentum='tone * mom', tone_x_volatility='tone * vol', tone_x_rsi='tone * ri', tone_x_volume='tone * vr', momentum_x_volatility='mom * vol', rsi_x_adx='ri * ad', bb_position_x_volume='bp * vr', returns_x_volume='ret * vr', drawdown_x_tone='dd * tone', trend_x_meanrev='tr * mr', regime_vol_x_momentum='rv * mom', sma_cross_x_adx='sx * ad')} FROM j"""))
def all_interactions(spark, sf_dir):
    """Oscillators as they are reported, to 6 digits; a date without an article has no tone."""
    rows = fe.interaction_inputs(m.daily_bars(spark, sf_dir))
    rows = rows.withColumns({c: F.round(c, 6) for c in ("rsi", "adx", "bb_position")})
    tone = m.articles(spark, sf_dir).groupBy("symbol", "date").agg(F.avg((F.col("n_chars") % 200) / 100.0 - 1).alias("tone"))
    return rounded(fe.all_interactions(rows.join(tone, ["symbol", "date"], "left").withColumn("tone", F.coalesce("tone", F.lit(0.0)))), *KEYS)
