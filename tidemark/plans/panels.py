"""Queries of spreads, stability, filing signals, profiles and tables for training, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import change, div, rounded
from ..operators import clean as c
from ..operators import features as fe
from ..operators import joins as j
from ..operators import panels as pn
from ..sources import market as m
from .registry import query, sql
from .technical import W, last, r, r8

SPREAD = f"""b AS (SELECT *, lag(ret) OVER w AS pr FROM rets {W}), c AS (SELECT *, CASE WHEN ret IS NOT NULL AND pr IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL AND pr IS NOT NULL THEN pr END AS y, ln(high / low) ** 2 AS hl, lag(high) OVER w AS ph, lag(low) OVER w AS pl, (ln(high) + ln(low)) / 2 AS mid FROM b {W}),
d AS (SELECT *, CASE WHEN count(x) OVER {last(19)} >= 19 THEN covar_samp(x, y) OVER {last(19)} END AS cv, hl + lag(hl) OVER w AS beta, ln(greatest(high, ph) / least(low, pl)) ** 2 AS gamma, 4 * (ln(close) - mid) * (ln(close) - lead(mid) OVER w) AS v FROM c {W}),
e AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0)) - sqrt(gamma / (3 - 2 * sqrt(2.0))) AS alpha FROM d),
f AS (SELECT symbol, date, list_aggregate([CASE WHEN cv IS NOT NULL THEN 2 * sqrt(greatest(-cv, 0.0)) END, CASE WHEN beta IS NOT NULL THEN greatest(2 * (exp(least(alpha, 50.0)) - 1) / (1 + exp(least(alpha, 50.0))), 0.0) END, CASE WHEN v > 0 THEN sqrt(v) END], 'median') AS spread FROM e)"""


@query("M5_consensus_spread", sql("rets", f""", {SPREAD}, g AS (SELECT *, CASE WHEN spread IS NOT NULL THEN 1 - (rank() OVER (PARTITION BY symbol ORDER BY round(spread, 12) NULLS LAST) + (count(*) OVER (PARTITION BY symbol, round(spread, 12)) - 1) / 2.0) / count(spread) OVER (PARTITION BY symbol) END AS liquidity FROM f)
SELECT symbol, date, {r(spread='spread', liquidity='liquidity')} FROM g"""))
def consensus_spread(spark, sf_dir):
    return rounded(fe.consensus_spread(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("M6_illiquidity", sql("rets", f""", {SPREAD}, g AS (SELECT *, CASE WHEN count(spread) OVER {last(100)} >= 20 THEN avg(spread) OVER {last(100)} END AS a, CASE WHEN count(spread) OVER {last(100)} >= 20 THEN stddev_samp(spread) OVER {last(100)} END AS s FROM f),
h AS (SELECT symbol, date, CASE WHEN s > 1e-12 THEN (spread - a) / s ELSE 0.0 END AS z FROM g) SELECT symbol, date, {r(z='z')}, CASE WHEN z > 2 THEN -1 ELSE 0 END AS signal FROM h"""))
def illiquidity(spark, sf_dir):
    return rounded(fe.illiquidity_signal(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("W21_residual_stability", sql("rets sectors", f""", x AS (SELECT rets.symbol, date, industry, coalesce(ret, 0.0) AS r FROM rets JOIN sectors ON rets.symbol = sectors.symbol),
y AS (SELECT symbol, date, r, avg(r) OVER (PARTITION BY date) AS m, coalesce((sum(r) OVER k - r) / nullif(count(*) OVER k - 1, 0), 0.0) AS p FROM x WINDOW k AS (PARTITION BY date, industry)),
z AS (SELECT symbol, date, list(r) OVER {last(64)} AS rs, list(m) OVER {last(64)} AS ms, list(p) OVER {last(64)} AS ps, coalesce(covar_pop(r, m) OVER {last(64)} / nullif(var_pop(m) OVER {last(64)}, 0), 0.0) AS beta FROM y),
e AS (SELECT symbol, date, beta, rs, ps, list_transform(range(1, len(rs) + 1), lambda i: rs[i] - beta * ms[i] - ps[i]) AS u FROM z WHERE len(rs) >= 10),
g AS (SELECT symbol, date, beta, list_sum(list_transform(range(2, len(u) + 1), lambda i: u[i] * u[i - 1])) AS num, list_sum(list_transform(range(1, len(u)), lambda i: u[i] * u[i])) AS den, list_sum(list_transform(range(1, len(u)), lambda i: (rs[i] - ps[i]) ** 2)) AS own FROM e)
SELECT y.symbol, y.date, {r(beta='coalesce(beta, 0.0)', stability='CASE WHEN beta IS NULL THEN 0.0 WHEN den > 1e-12 * own THEN greatest(1 - abs(num / den), 0.0) ELSE 1.0 END')} FROM y LEFT JOIN g ON y.symbol = g.symbol AND y.date = g.date"""))
def residual_stability(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).join(m.sectors(spark, sf_dir), "symbol")
    return rounded(pn.residual_stability(pn.with_market_and_peers(rows, "industry")), "symbol", "date")


@query("M34_signature_slope", sql("bars", f""", a AS (SELECT symbol, date, row_number() OVER w - 20 AS k, list(close) OVER {last(60)} AS c FROM bars {W}), p AS (SELECT * FROM a WHERE k >= 0 AND k % 5 = 0),
q AS (SELECT symbol, date, f, ln(c[i * f + 1] / c[i * f - f + 1]) AS lr FROM p, (VALUES (1), (2), (5), (10), (15)) AS s(f), range(1, 60) AS t(i) WHERE i * f < len(c)),
v AS (SELECT symbol, date, f, stddev_samp(lr) * sqrt(252.0 / f) AS vol FROM q GROUP BY symbol, date, f HAVING count(lr) >= 2), o AS (SELECT symbol, date, regr_slope(vol, f) AS slope FROM v GROUP BY symbol, date HAVING count(*) >= 2)
SELECT b.symbol, b.date, round(coalesce(last_value(slope IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.date), 0.0), 6) AS slope FROM bars b LEFT JOIN o ON b.symbol = o.symbol AND b.date = o.date"""))
def signature_slope(spark, sf_dir):
    return rounded(pn.signature_slope(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("G24_drift_adjustment", sql("rets disclosures", f""", v AS (SELECT symbol, date AS event, (max(amount) / 150000 - 1) * 100 AS s FROM disclosures GROUP BY 1, 2), q AS (SELECT r.symbol, r.date, least(abs(ret) * 10, 1.0) AS raw, s, r.date - event AS days FROM rets r ASOF LEFT JOIN v ON r.symbol = v.symbol AND r.date >= v.event WHERE ret IS NOT NULL),
k AS (SELECT *, CASE WHEN days BETWEEN 1 AND 60 AND s >= 5 THEN 1.25 WHEN days BETWEEN 1 AND 60 AND s <= -5 THEN 0.85 ELSE 1.0 END AS multiplier FROM q)
SELECT symbol, date, {r(confidence_raw='raw', surprise_pct='s')}, CAST(days AS INTEGER) AS days_since, CAST(multiplier AS DOUBLE) AS multiplier, {r(confidence='least(greatest(raw * multiplier, 0.0), 1.0)')} FROM k"""))
def drift_adjustment(spark, sf_dir):
    events = m.disclosures(spark, sf_dir).groupBy("symbol", "date").agg(((F.max("amount") / 150000 - 1) * 100).alias("surprise_pct"))
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).select("symbol", "date", F.least(F.abs("ret") * 10, F.lit(1.0)).alias("confidence"), "ret").where("ret is not null").drop("ret")
    met = j.as_of(rows, events, "date", ["surprise_pct"]).withColumn("days_since", F.date_diff("date", "matched_date"))
    return rounded(pn.drift_adjusted(met).select("symbol", "date", "confidence_raw", "surprise_pct", "days_since", "multiplier", "confidence"), "symbol", "date")


RECENT = "n AS (SELECT * FROM disclosures WHERE date >= (SELECT max(date) - 90 FROM disclosures))"


@query("R31_insider_signal", sql("disclosures", f""", {RECENT}, s AS (SELECT symbol, count(*) FILTER (kind = 'buy') AS n_buys, count(*) FILTER (kind = 'sell') AS n_sells, sum(CASE WHEN kind = 'buy' THEN amount ELSE 0.0 END) AS b, sum(CASE WHEN kind = 'sell' THEN amount ELSE 0.0 END) AS s FROM n WHERE amount >= 10000 GROUP BY symbol), t AS (SELECT *, CAST(n_buys - n_sells AS DOUBLE) / (n_buys + n_sells + 1) AS q FROM s)
SELECT symbol, CASE WHEN q > 0.3 THEN 1 WHEN q < -0.3 THEN -1 ELSE 0 END AS signal, {r(sentiment_score='q', value_sentiment='coalesce((b - s) / nullif(b + s, 0), 0.0)')}, n_buys, n_sells FROM t"""))
def insider_signal(spark, sf_dir):
    return rounded(pn.insider_signal(c.recent(m.disclosures(spark, sf_dir), "date", 90, 10000.0)), "symbol")


@query("R31_congress_signal", sql("disclosures", f""", {RECENT}, t AS (SELECT *, floor(amount / 50000) * 50000 + 25000.5 AS mid FROM n), s AS (SELECT symbol, count(*) FILTER (kind = 'buy') AS n_buys, count(*) FILTER (kind = 'sell') AS n_sells, sum(mid) AS amount FROM t GROUP BY symbol)
SELECT symbol, CAST(sign(n_buys - n_sells) AS INTEGER) AS signal, n_buys, n_sells, {r(sentiment='coalesce(CAST(n_buys - n_sells AS DOUBLE) / nullif(n_buys + n_sells, 0), 0.0)', confidence='least((n_buys + n_sells) / 5.0, 1.0)', amount='amount')} FROM s"""))
def congress_signal(spark, sf_dir):
    low = F.floor(F.col("amount") / 50000) * 50000
    text = F.concat(F.lit("$"), F.format_number(low + 1, 0), F.lit(" - $"), F.format_number(low + 50000, 0))
    rows = c.recent(m.disclosures(spark, sf_dir), "date", 90, 0.0).withColumn("range", text)
    return rounded(pn.congress_signal(rows.withColumn("amount", pn.amount_middle("range"))), "symbol")


@query("A32_calibration", sql("rets", f""", a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM rets), t AS (SELECT symbol, date, close, CASE WHEN k < 120 THEN ret END AS x, (high - low) / nullif(close, 0) AS g, CASE WHEN volume > 0 THEN ln(volume) END AS l FROM a WHERE k <= 120),
s AS (SELECT symbol, avg(x) AS xm, stddev_samp(x) AS xs, avg(g) AS gm, stddev_samp(g) AS gs, avg(l) AS lm, stddev_samp(l) AS ls, max_by(close, date) AS last_close FROM t GROUP BY symbol)
SELECT symbol, {r8(return_mean='coalesce(xm, 0.0002)', return_std='CASE WHEN xs > 1e-6 THEN xs ELSE 0.012 END', range_mean='coalesce(gm, 0.015)', range_std='CASE WHEN gs > 1e-6 THEN gs ELSE 0.006 END', volume_mean='coalesce(lm, 15.0)', volume_std='CASE WHEN ls > 1e-6 THEN ls ELSE 0.5 END', last_close='last_close')} FROM s"""))
def calibration(spark, sf_dir):
    return rounded(pn.calibration(m.daily_bars(spark, sf_dir)), "symbol", digits=8)


@query("A30_profile_returns", sql("rets", f""", d AS (SELECT date, avg(coalesce(ret, 0.0)) AS x FROM rets GROUP BY date), e AS (SELECT min(date) AS lo, max(date) AS hi FROM d)
SELECT date, {r8(profile_return='x - CASE WHEN lo < hi AND (date = lo OR date = hi) THEN 0.0005 ELSE 0.0 END')} FROM d, e"""))
def profile_returns(spark, sf_dir):
    return rounded(pn.profile_returns(m.with_returns(m.daily_bars(spark, sf_dir)), 5.0), "date", digits=8)


@query("S9_article_span", sql("articles", "SELECT symbol, count(*) AS n, count(*) FILTER (id % 3 <> 0) AS n_unscored, min(date) AS first_date, max(date) AS last_date FROM articles WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY symbol"))
def article_span(spark, sf_dir):
    rows = m.articles(spark, sf_dir).withColumn("score", F.when(F.col("id") % 3 == 0, 1.0))
    return pn.article_span(rows, "1996-01-01", "1997-12-31", "score")


@query("S21_one_schema", sql("disclosures", "SELECT CAST(symbol AS VARCHAR) AS symbol, date, kind, round(amount, 6) AS amount, o_orderkey % 2 = 0 AS upper FROM disclosures"))
def one_schema(spark, sf_dir):
    rows = m.disclosures(spark, sf_dir)
    upper = rows.where("o_orderkey % 2 = 0").select(F.col("symbol").cast("string").alias("ticker"), F.col("date").alias("transaction_date"), F.col("kind").alias("type"), "amount", F.lit(True).alias("senate"))
    lower = rows.where("o_orderkey % 2 <> 0").select(F.col("symbol").cast("string").alias("symbol"), F.col("date").alias("trade_date"), "kind", F.col("amount").alias("value"), F.lit(False).alias("house"))
    aliases = {"symbol": ["ticker", "symbol"], "date": ["transaction_date", "trade_date"], "kind": ["type", "kind"], "amount": ["amount", "value"], "upper": ["senate", "house"]}
    return rounded(pn.one_schema([upper, lower], aliases), "symbol", "date")


@query("V52_training_table", sql("rets", f""", a AS (SELECT symbol, date, ret, (high - low) / nullif(close, 0) AS spread, volume / nullif(avg(volume) OVER {last(20)}, 0) - 1 AS volume_ratio, lead(close, 5) OVER w / nullif(close, 0) - 1 AS f FROM rets {W}), b AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY symbol) AS n FROM a WHERE ret IS NOT NULL AND spread IS NOT NULL AND volume_ratio IS NOT NULL AND f IS NOT NULL {W}),
t AS (SELECT *, CASE WHEN k <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM b), s AS (SELECT avg(ret) AS m1, stddev_pop(ret) AS s1, avg(spread) AS m2, stddev_pop(spread) AS s2, avg(volume_ratio) AS m3, stddev_pop(volume_ratio) AS s3 FROM t WHERE part = 'train')
SELECT symbol, date, part, CASE WHEN f > 0.005 THEN 2 WHEN f < -0.005 THEN 0 ELSE 1 END AS label, {r(ret='(ret - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END', spread='(spread - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END', volume_ratio='(volume_ratio - m3) / CASE WHEN s3 > 0 THEN s3 ELSE 1 END')} FROM t, s"""))
def training_table(spark, sf_dir):
    from ..functions.frames import last_rows

    rows = m.daily_bars(spark, sf_dir).withColumns({"ret": change("close"), "spread": div(F.col("high") - F.col("low"), "close"), "volume_ratio": div("volume", F.avg("volume").over(last_rows(20))) - 1})
    return rounded(pn.training_table(rows, ["ret", "spread", "volume_ratio"]), "symbol", "date", "part", "label")
