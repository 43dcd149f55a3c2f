"""Queries of portfolios and validation, each with its SQL where SQL has the same hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import across, change, div, lead, pct_rank, rounded
from ..operators import portfolio as p
from ..sources import market as m
from .cross import rank_sql
from .registry import query, sql
from .technical import W, r, roll


def scored(spark, sf_dir):
    """Momentum rank per date and the return of the next row."""
    bars = m.daily_bars(spark, sf_dir)
    rows = bars.select("symbol", "date", change("close", 21).alias("momentum"), (div(lead("close"), "close") - 1).alias("forward_return"))
    return rows.withColumn("score", pct_rank("momentum"))


SCORED = f"""mo AS (SELECT symbol, date, close / nullif(lag(close, 21) OVER w, 0) - 1 AS momentum, lead(close) OVER w / nullif(close, 0) - 1 AS forward_return FROM bars {W}),
scored AS (SELECT *, {rank_sql('momentum')} AS score FROM mo)"""
TOP = f"{SCORED}, top AS (SELECT date, avg(forward_return) AS ret, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS k FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL) WHERE k <= 5 GROUP BY date)"


@query("flagship", sql("bars", f", {TOP} SELECT date, round(ret, 6) AS ret, n FROM top"))
def flagship(spark, sf_dir):
    """Bars, 21-row momentum, rank per date, the five best, their next return: two shuffles and a limit per date."""
    return rounded(p.top_k(scored(spark, sf_dir), "score", 5, "forward_return"), "date")


def per_symbol(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).withColumn("market", F.avg("ret").over(across("date")))
    return rows.where("ret is not null")


SYM = "sym AS (SELECT * FROM (SELECT *, avg(ret) OVER (PARTITION BY date) AS market FROM rets) WHERE ret IS NOT NULL)"


@query("V1_performance", sql("rets", f""", {SYM}, g AS (SELECT *, exp(sum(ln(1 + greatest(ret, -0.999999))) OVER w) AS growth FROM sym {W}), dd AS (SELECT *, growth / greatest(max(growth) OVER w, 1.0) - 1 AS dd FROM g {W}),
s AS (SELECT symbol, count(*) AS n, exp(sum(ln(1 + greatest(ret, -0.999999)))) - 1 AS tr, avg(ret) AS mn, stddev_samp(ret) AS sd, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0.0 END)) AS dn, min(dd) AS mdd, sqrt(avg(dd * dd)) AS ulcer, quantile_cont(ret, 0.05) AS v5, avg(CAST(ret > 0 AS DOUBLE)) AS win,
avg(CASE WHEN ret > 0 THEN ret END) / nullif(-avg(CASE WHEN ret < 0 THEN ret END), 0) AS payoff, sum(CASE WHEN ret > 0 THEN ret ELSE 0.0 END) / nullif(-sum(CASE WHEN ret < 0 THEN ret ELSE 0.0 END), 0) AS pf FROM dd GROUP BY symbol),
c AS (SELECT sym.symbol, avg(ret) AS cvar FROM sym JOIN s USING (symbol) WHERE ret <= v5 GROUP BY sym.symbol)
SELECT symbol, n, {r(total_return='tr', cagr='(1 + tr) ** (252.0 / n) - 1', calmar='((1 + tr) ** (252.0 / n) - 1) / nullif(abs(mdd), 0)', volatility='sd * sqrt(252.0)', sharpe='mn / nullif(sd, 0) * sqrt(252.0)', sortino='mn / nullif(dn, 0) * sqrt(252.0)', max_drawdown='mdd', ulcer='ulcer', var_5='v5', cvar_5='cvar', win_rate='win', payoff='payoff', profit_factor='pf')} FROM s LEFT JOIN c USING (symbol)"""))
def performance(spark, sf_dir):
    return rounded(p.performance(per_symbol(spark, sf_dir), "symbol"), "symbol", "n")


@query("V1_streaks", sql("rets", f""", {SYM}, g AS (SELECT *, exp(sum(ln(1 + greatest(ret, -0.999999))) OVER w) AS growth FROM sym {W}), dd AS (SELECT *, growth / greatest(max(growth) OVER w, 1.0) - 1 AS dd, row_number() OVER w AS k FROM g {W}),
o AS (SELECT *, k - coalesce(max(CASE WHEN NOT ret > 0 THEN k END) OVER w, 0) AS a, k - coalesce(max(CASE WHEN NOT ret < 0 THEN k END) OVER w, 0) AS b, k - coalesce(max(CASE WHEN NOT dd < 0 THEN k END) OVER w, 0) AS c FROM dd {W})
SELECT symbol, CAST(max(a) AS INTEGER) AS wins, CAST(max(b) AS INTEGER) AS losses, CAST(max(c) AS INTEGER) AS under_water, round((last(growth ORDER BY date) - 1) / nullif(abs(min(dd)), 0), 6) AS recovery FROM o GROUP BY symbol"""))
def streaks(spark, sf_dir):
    return rounded(p.streaks(per_symbol(spark, sf_dir), "symbol"), "symbol", "wins", "losses", "under_water")


@query("V2_relative", sql("rets", f""", {SYM}, s AS (SELECT symbol, count(*) AS n, covar_samp(ret, market) / nullif(var_pop(market), 0) AS b, avg(ret) AS r, avg(market) AS mk, avg(ret - market) AS a, stddev_samp(ret - market) AS te, avg(CASE WHEN market > 0 THEN ret END) / nullif(avg(CASE WHEN market > 0 THEN market END), 0) AS up, avg(CASE WHEN market < 0 THEN ret END) / nullif(avg(CASE WHEN market < 0 THEN market END), 0) AS dn FROM sym GROUP BY symbol)
SELECT symbol, n, {r(beta='b', alpha='r - b * mk', tracking_error='te', information_ratio='a / nullif(te, 0)', up_capture='up', down_capture='dn')} FROM s"""))
def relative(spark, sf_dir):
    return rounded(p.relative(per_symbol(spark, sf_dir), "symbol"), "symbol", "n")


@query("V3_value_at_risk", sql("rets", f""", {SYM}, s AS (SELECT symbol, count(*) AS n, quantile_cont(ret, 0.05) AS q, avg(ret) AS m, stddev_samp(ret) AS s, stddev_pop(ret) AS sp, avg(ret ** 3) AS m3, avg(ret ** 4) AS m4, avg(ret ** 2) AS m2 FROM sym GROUP BY symbol),
k AS (SELECT *, (m3 - 3 * m * m2 + 2 * m * m * m) / nullif(sp ** 3, 0) AS sk, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / nullif(sp ** 4, 0) - 3 AS ku, -1.6448536269514722 AS z FROM s), c AS (SELECT sym.symbol, -avg(ret) AS cvar FROM sym JOIN s USING (symbol) WHERE ret <= q GROUP BY sym.symbol)
SELECT symbol, n, {r(var_historical='-q', var_normal='-(m + z * s)', var_cornish_fisher='-(m + (z + (z * z - 1) * sk / 6 + (z ** 3 - 3 * z) * ku / 24 - (2 * z ** 3 - 5 * z) * sk * sk / 36) * s)', cvar='cvar')} FROM k JOIN c USING (symbol)"""))
def value_at_risk(spark, sf_dir):
    return rounded(p.value_at_risk(per_symbol(spark, sf_dir), "symbol"), "symbol", "n")


@query("V4_kelly", sql("rets", f""", {SYM}, s AS (SELECT symbol, avg(CAST(ret > 0 AS DOUBLE)) AS w, avg(CASE WHEN ret > 0 THEN ret END) / nullif(-avg(CASE WHEN ret < 0 THEN ret END), 0) AS b FROM sym WHERE ret <> 0 GROUP BY symbol)
SELECT symbol, {r(win_rate='w', payoff='b', kelly='CASE WHEN b > 0 THEN least(greatest(w - (1 - w) / b, 0.0), 1.0) END')} FROM s"""))
def kelly(spark, sf_dir):
    return rounded(p.kelly(per_symbol(spark, sf_dir), "symbol"), "symbol")


@query("V5_stepped_long_short", sql("bars", f""", {SCORED}, d AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d FROM (SELECT DISTINCT date FROM scored)) WHERE d % 5 = 0),
k AS (SELECT date, forward_return, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS h, row_number() OVER (PARTITION BY date ORDER BY score ASC, symbol) AS l FROM scored JOIN d USING (date) WHERE score IS NOT NULL AND forward_return IS NOT NULL),
s AS (SELECT date, avg(CASE WHEN h <= 3 THEN forward_return END) AS lg, avg(CASE WHEN l <= 3 THEN forward_return END) AS sh FROM k GROUP BY date) SELECT date, {r(long_return='lg', short_return='sh', spread='lg - sh')} FROM s"""))
def stepped_long_short(spark, sf_dir):
    return rounded(p.stepped_long_short(scored(spark, sf_dir), "score", "forward_return", 5, 3), "date")


BOOK = f"{SCORED}, book AS (SELECT date, symbol FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS k FROM scored WHERE score IS NOT NULL) WHERE k <= 5)"


@query("V6_turnover", sql("bars", f""", {BOOK}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM book)), n AS (SELECT d, symbol FROM book JOIN d USING (date)), j AS (SELECT coalesce(a.d, b.d + 1) AS d, a.symbol IS NULL OR b.symbol IS NULL AS ch FROM n a FULL JOIN n b ON a.d = b.d + 1 AND a.symbol = b.symbol)
SELECT date, count(*) FILTER (ch) AS changed, count(*) AS names FROM j JOIN d USING (d) GROUP BY date"""))
def turnover(spark, sf_dir):
    from pyspark.sql.window import Window

    ranked = scored(spark, sf_dir).where("score is not null").withColumn("_k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol")))
    return p.turnover(ranked.where("_k <= 5").select("date", "symbol"))


@query("V7_capped_book", sql("bars sectors", f""", {SCORED}, k AS (SELECT date, symbol, sector, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, symbol) AS h, row_number() OVER (PARTITION BY date, sector ORDER BY score ASC, symbol) AS l, count(*) OVER (PARTITION BY date, sector) AS n FROM scored JOIN sectors USING (symbol) WHERE score IS NOT NULL),
s AS (SELECT date, symbol, CASE WHEN h <= 1 THEN 1 WHEN l <= 1 THEN -1 END AS side FROM k WHERE n >= 2), b AS (SELECT * FROM s WHERE side IS NOT NULL) SELECT date, symbol, side, round(side * 0.5 / count(*) OVER (PARTITION BY date, side), 6) AS weight FROM b"""))
def capped_book(spark, sf_dir):
    rows = scored(spark, sf_dir).join(m.sectors(spark, sf_dir), "symbol")
    return rounded(p.capped_book(rows, "score", "sector", 1).select("date", "symbol", "side", "weight"), "date", "symbol", "side")


@query("V8_segments", sql("bars", f""", {TOP}, g AS (SELECT CASE WHEN year(date) <= 1997 THEN 'early' ELSE 'late' END AS segment, ret FROM top) SELECT segment, count(*) AS n, {r(mean='avg(ret)', std='stddev_samp(ret)')} FROM g GROUP BY segment UNION ALL SELECT 'all', count(*), {r(mean='avg(ret)', std='stddev_samp(ret)')} FROM g"""))
def segments(spark, sf_dir):
    top = p.top_k(scored(spark, sf_dir), "score", 5, "forward_return").withColumn("segment", F.when(F.year("date") <= 1997, "early").otherwise("late"))
    out = top.rollup("segment").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"))
    return rounded(out.select(F.coalesce("segment", F.lit("all")).alias("segment"), "n", "mean", "std"), "segment", "n")


@query("V9_cost_sensitivity", sql("bars", f", {TOP} SELECT bps, round(avg(ret - 1.0 * bps / 10000), 6) AS mean, count(*) AS n FROM top, (VALUES (0), (5), (10), (25)) AS b(bps) GROUP BY bps"))
def cost_sensitivity(spark, sf_dir):
    top = p.top_k(scored(spark, sf_dir), "score", 5, "forward_return").withColumn("bps", F.explode(F.array(*map(F.lit, (0, 5, 10, 25)))))
    return rounded(top.groupBy("bps").agg(F.avg(F.col("ret") - F.col("bps") / 10000).alias("mean"), F.count("*").alias("n")), "bps")


@query("V10_beat_ratio", sql("rets", f""", {SYM}, a AS (SELECT symbol, {roll('sum', 'ret', 20)} AS a, {roll('sum', 'market', 20)} AS b FROM sym) SELECT symbol, round(avg(CAST(a > b AS DOUBLE)), 6) AS beat_ratio, count(*) AS n FROM a WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY symbol"""))
def beat_ratio(spark, sf_dir):
    return rounded(p.beat_ratio(per_symbol(spark, sf_dir), 20), "symbol")


@query("V11_sweep", sql("bars", f""", {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rk FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL),
d AS (SELECT k, threshold, date, avg(forward_return) AS ret FROM k, (VALUES (3), (5), (10)) AS a(k), (VALUES (0.0), (0.5), (0.8)) AS b(threshold) WHERE rk <= k AND score >= threshold GROUP BY k, threshold, date)
SELECT CAST(k AS INTEGER) AS k, CAST(threshold AS DOUBLE) AS threshold, count(*) AS n, {r(mean='avg(ret)', std='stddev_samp(ret)')} FROM d GROUP BY k, threshold"""))
def sweep(spark, sf_dir):
    return rounded(p.sweep(scored(spark, sf_dir), "score", "forward_return", (3, 5, 10), (0.0, 0.5, 0.8)), "k", "n")


@query("V14_information_coefficient", sql("bars", f""", {SCORED}, b AS (SELECT symbol, date, momentum, forward_return, volume FROM scored JOIN (SELECT symbol, date, volume FROM bars) USING (symbol, date)),
l AS (SELECT date, 'momentum' AS factor, momentum AS value, forward_return FROM b UNION ALL SELECT date, 'volume', volume, forward_return FROM b), n AS (SELECT * FROM l WHERE value IS NOT NULL AND forward_return IS NOT NULL),
k AS (SELECT date, factor, {rank_sql('value', 'date, factor')} AS x, {rank_sql('forward_return', 'date, factor')} AS y FROM n)
SELECT factor, date, count(*) AS n, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS ic FROM k GROUP BY factor, date"""))
def information_coefficient(spark, sf_dir):
    rows = scored(spark, sf_dir).join(m.daily_bars(spark, sf_dir).select("symbol", "date", "volume"), ["symbol", "date"])
    return rounded(p.information_coefficient(rows, ["momentum", "volume"], "forward_return"), "factor", "date", "n")


@query("V15_permutation_test")
def permutation_test(spark, sf_dir):
    return rounded(p.permutation_test(per_symbol(spark, sf_dir).select("symbol", "date", "ret"), "symbol"), "symbol")


@query("V16_bootstrap")
def bootstrap(spark, sf_dir):
    return rounded(p.bootstrap(per_symbol(spark, sf_dir).select("symbol", "date", "ret"), "symbol"), "symbol")


@query("V19_walk_forward", sql("bars", """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)), f AS (SELECT f AS fold, date, d - f * 100 AS k FROM d, range(0, 1000) AS r(f) WHERE d >= f * 100 AND d < f * 100 + 500 AND f * 100 + 500 <= n)
SELECT CAST(fold AS BIGINT) AS fold, CASE WHEN k < 400 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars JOIN f USING (date) GROUP BY 1, 2"""))
def walk_forward(spark, sf_dir):
    return p.walk_forward_folds(m.daily_bars(spark, sf_dir), 400, 100)


@query("V26_inverse_variance", sql("rets", f", v AS (SELECT symbol, date, {roll('var_samp', 'ret', 20)} AS v FROM rets), i AS (SELECT symbol, date, 1 / v AS i FROM v WHERE v > 0) SELECT symbol, date, round(i / nullif(sum(i) OVER (PARTITION BY date), 0), 6) AS weight FROM i"))
def inverse_variance(spark, sf_dir):
    return rounded(p.inverse_variance(m.daily_bars(spark, sf_dir)), "symbol", "date")


EXPO = "bk AS (SELECT symbol, sum(price * quantity) AS exposure FROM ticks GROUP BY symbol)"


def book(spark, sf_dir):
    return m.ticks(spark, sf_dir).groupBy("symbol").agg(F.sum(F.col("price") * F.col("quantity")).alias("exposure")).join(m.sectors(spark, sf_dir), "symbol")


@query("V31_limit_breaches", sql("ticks sectors", f""", {EXPO}, s AS (SELECT symbol, sector, abs(exposure) / nullif(sum(abs(exposure)) OVER (), 0) AS share FROM bk JOIN sectors USING (symbol))
SELECT 'position' AS kind, CAST(symbol AS BIGINT) AS key, round(share, 6) AS share FROM s WHERE share > 0.0101 UNION ALL SELECT 'cluster', CAST(sector AS BIGINT), round(sum(share), 6) FROM s GROUP BY sector HAVING sum(share) > 0.2"""))
def limit_breaches(spark, sf_dir):
    return rounded(p.limit_breaches(book(spark, sf_dir), "sector", 0.0101, 0.2), "kind", "key")


@query("V32_stress", sql("ticks sectors", f""", {EXPO} SELECT scenario, {r(loss='sum(exposure * shock)', worst='min(exposure * shock)')}, count(*) AS n FROM bk JOIN sectors USING (symbol) JOIN (SELECT r_regionkey AS sector, s AS scenario, -0.1 * (1 + (r_regionkey + s) % 4) AS shock FROM region, range(0, 5) AS q(s)) USING (sector) GROUP BY scenario"""))
def stress(spark, sf_dir):
    shocks = m.table(spark, sf_dir, "region").withColumn("scenario", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))).select(F.col("r_regionkey").alias("sector"), "scenario", (-0.1 * (1 + (F.col("r_regionkey") + F.col("scenario")) % 4)).alias("shock"))
    return rounded(p.stress(book(spark, sf_dir), shocks, "sector"), "scenario", "n")
