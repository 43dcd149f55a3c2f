"""Queries of cross-sectional operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import cross_z, pct_rank, rounded, safe_pct_rank
from ..operators import aggregates as a
from ..operators import cross as x
from ..sources import market as m
from .registry import query, sql
from .technical import W, ema_sql, last, r, roll


def rank_sql(c: str, by: str = "date") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"


def z_sql(c: str) -> str:
    k = f"coalesce({c}, 0.0)"
    return f"CASE WHEN stddev_pop({k}) OVER d <= 1e-12 THEN 0.0 ELSE ({k} - avg({k}) OVER d) / nullif(stddev_pop({k}) OVER d, 0.0) END"


def with_sector(spark, sf_dir):
    return m.with_returns(m.daily_bars(spark, sf_dir)).join(m.sectors(spark, sf_dir), "symbol")


@query("R1_momentum_ranks", sql("rets", f""", a AS (SELECT *, {', '.join(f'close / nullif(lag(close, {n}) OVER w, 0) - 1 AS m{n}' for n in (5, 21, 63))}, {roll('stddev_samp', 'ret', 21)} AS v FROM rets {W})
SELECT symbol, date, {r(**{f'rank_{n}': f'coalesce({rank_sql(f"m{n}")}, 0.5)' for n in (5, 21, 63)}, rank_calm=f"coalesce(1 - {rank_sql('v')}, 0.5)", relative_strength='m21 - avg(m21) OVER (PARTITION BY date)')} FROM a"""))
def momentum_ranks(spark, sf_dir):
    return rounded(x.momentum_ranks(m.daily_bars(spark, sf_dir), m.by_date(spark, sf_dir)), "symbol", "date")


@query("R2_rank_and_z", sql("rets", f""", v AS (SELECT symbol, date, volume, ret FROM rets) SELECT symbol, date, {r(rank=rank_sql('volume'), safe_rank=f"CASE WHEN min(volume) OVER d IS NOT DISTINCT FROM max(volume) OVER d THEN 0.5 ELSE {rank_sql('volume')} END", z=z_sql('ret'))} FROM v WINDOW d AS (PARTITION BY date)"""))
def rank_and_z(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir))
    return rounded(rows.select("symbol", "date", pct_rank("volume").alias("rank"), safe_pct_rank("volume").alias("safe_rank"), cross_z("ret").alias("z")), "symbol", "date")


@query("R3_event_features", sql("rets", f""", e AS (SELECT *, CASE WHEN abs(ret) > 0.3 THEN CAST(sign(ret) AS DOUBLE) END AS e, row_number() OVER w AS k FROM rets {W}),
l AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS le, last_value(CASE WHEN e IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS lk FROM e)
SELECT symbol, date, {r(pead='coalesce(le * exp(-(k - lk) / 20.0), 0.0)', intensity=f"coalesce(CASE WHEN count(e) OVER {last(20)} >= 1 THEN sum(abs(e)) OVER {last(20)} END, 0.0)")} FROM l"""))
def event_features(spark, sf_dir):
    return rounded(x.event_features(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("R4_relative_value", sql("rets sectors", f""", a AS (SELECT symbol, date, sector, close, ret FROM rets JOIN sectors USING (symbol)), b AS (SELECT symbol, date, close / nullif(avg(close) OVER c, 0) - 1 AS basis, CASE WHEN count(ret) OVER c > 1 AND ret IS NOT NULL THEN ret - (sum(ret) OVER c - ret) / (count(ret) OVER c - 1) END AS residual FROM a WINDOW c AS (PARTITION BY date, sector))
SELECT symbol, date, {r(residual='residual', residual_z=f"(residual - ({roll('avg', 'residual', 20, 10)})) / nullif({roll('stddev_samp', 'residual', 20, 10)}, 0)", basis='basis')} FROM b"""))
def relative_value(spark, sf_dir):
    return rounded(x.relative_value(with_sector(spark, sf_dir), "sector"), "symbol", "date")


@query("R6_execution_costs", sql("bars", f""", a AS (SELECT *, close * volume AS dvol FROM bars), b AS (SELECT *, {roll('avg', 'dvol', 20, 1)} AS dv, lag(volume) OVER w AS pv FROM a {W}),
c AS (SELECT *, CASE WHEN min(dv) OVER d IS NOT DISTINCT FROM max(dv) OVER d THEN 0.5 ELSE {rank_sql('dv')} END AS lr FROM b WINDOW d AS (PARTITION BY date))
SELECT symbol, date, CAST(floor(least(lr * 5, 4.999)) AS INTEGER) AS liquidity_bucket, {r(liquidity_rank='lr', spread_cost='(high - low) / nullif(close, 0) * (1 - lr)', turnover_cost='abs(volume - pv) / nullif(pv, 0)')} FROM c"""))
def execution_costs(spark, sf_dir):
    return rounded(x.execution_costs(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("R7_composite", sql("rets", f""", a AS (SELECT symbol, date, close / nullif(lag(close, 21) OVER w, 0) - 1 AS m, -(close / nullif(lag(close, 5) OVER w, 0) - 1) AS rv, -({roll('stddev_samp', 'ret', 21)}) AS c FROM rets {W})
SELECT symbol, date, round(0.5 * ({z_sql('m')}) + 0.3 * ({z_sql('rv')}) + 0.2 * ({z_sql('c')}), 6) AS composite FROM a WINDOW d AS (PARTITION BY date)"""))
def composite(spark, sf_dir):
    return rounded(x.composite(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("R8_research_panel", sql("rets sectors", f""", a AS (SELECT symbol, date, avg(ret) OVER (PARTITION BY date) AS market, avg(ret) OVER (PARTITION BY date, sector) AS peer, ret FROM rets JOIN sectors USING (symbol)), b AS (SELECT *, ret - 0.5 * market - 0.5 * peer AS residual FROM a)
SELECT symbol, date, {r(market='market', peer='peer', residual_1='residual', residual_5=roll('sum', 'residual', 5), residual_20=roll('sum', 'residual', 20))}, count(residual) OVER {last(20)} >= 20 AS complete FROM b"""))
def research_panel(spark, sf_dir):
    return rounded(x.research_panel(with_sector(spark, sf_dir), "sector"), "symbol", "date")


@query("R10_state_probabilities", sql("rets", f""", a AS (SELECT *, {roll('stddev_samp', 'ret', 20)} AS v FROM rets), b AS (SELECT symbol, date, coalesce((v - ({roll('avg', 'v', 60, 20)})) / nullif({roll('stddev_samp', 'v', 60, 20)}, 0), 0.0) AS z FROM a),
c AS (SELECT symbol, date, 1 / (1 + exp(-z)) AS stress FROM b), d AS (SELECT *, {ema_sql('stress', 10)} AS s FROM c), e AS (SELECT *, least(greatest(s, 1e-9), 1 - 1e-9) AS p FROM d)
SELECT symbol, date, {r(stress='stress', stress_smooth='s', entropy='-(p * ln(p) + (1 - p) * ln(1 - p))')} FROM e"""))
def state_probabilities(spark, sf_dir):
    return rounded(x.state_probabilities(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("R11_graph_features", sql("rets sectors", f""", a AS (SELECT symbol, date, ret, stddev_pop(ret) OVER c AS dispersion, CASE WHEN count(ret) OVER c > 1 AND ret IS NOT NULL THEN (sum(ret) OVER c - ret) / (count(ret) OVER c - 1) END AS nb FROM rets JOIN sectors USING (symbol) WINDOW c AS (PARTITION BY date, sector))
SELECT symbol, date, {r(laplacian='ret - nb', dispersion='dispersion', shock='lag(nb) OVER w')} FROM a {W}"""))
def graph_features(spark, sf_dir):
    return rounded(x.graph_features(with_sector(spark, sf_dir), "sector"), "symbol", "date")


P20 = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("R12_uncertainty", sql("rets", f""", a AS (SELECT *, {roll('avg', 'ret', 20)} AS f FROM rets), b AS (SELECT symbol, date, abs(ret - lag(f) OVER w) AS err FROM a {W}), c AS (SELECT *, CASE WHEN count(err) OVER {P20} >= 20 THEN 2 * quantile_cont(err, 0.9) OVER {P20} END AS width FROM b),
d AS (SELECT *, CASE WHEN width IS NOT NULL AND err IS NOT NULL THEN CAST(2 * err > width AS DOUBLE) END AS miss FROM c)
SELECT symbol, date, {r(width='width', miss_rate=roll('avg', 'miss', 20, 5), usual_width='quantile_cont(width, 0.5) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)')} FROM d"""))
def uncertainty(spark, sf_dir):
    return rounded(x.uncertainty(m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("R15_top_bottom", sql("bars", f""", a AS (SELECT symbol, date, close / nullif(lag(close, 21) OVER w, 0) - 1 AS mom FROM bars {W})
SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY mom DESC, symbol) <= 3 THEN 1 WHEN row_number() OVER (PARTITION BY date ORDER BY mom ASC, symbol) <= 3 THEN -1 ELSE 0 END AS signal FROM a WHERE mom IS NOT NULL"""))
def top_bottom(spark, sf_dir):
    from ..functions.frames import change

    rows = m.daily_bars(spark, sf_dir).select("symbol", "date", change("close", 21).alias("mom"))
    return x.top_bottom(rows, "mom", 3).select("symbol", "date", "signal")


@query("R16_adaptive_momentum", sql("rets", f""", a AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS mk FROM rets), b AS (SELECT *, {roll('stddev_samp', 'mk', 20)} AS v FROM a),
c AS (SELECT symbol, date, CASE WHEN v > 0.5 THEN close / nullif(lag(close, 5) OVER w, 0) - 1 WHEN v > 0.2 THEN close / nullif(lag(close, 10) OVER w, 0) - 1 ELSE close / nullif(lag(close, 21) OVER w, 0) - 1 END AS mom FROM b {W})
SELECT symbol, date, round(mom, 6) AS momentum, round({rank_sql('mom')}, 6) AS momentum_rank FROM c"""))
def adaptive_momentum(spark, sf_dir):
    return rounded(x.adaptive_momentum(m.daily_bars(spark, sf_dir)), "symbol", "date")


RATIOS = "ra AS (SELECT symbol, price / nullif(ebit / nullif(shares, 0), 0) AS pe, price * shares / nullif(revenue, 0) AS ps, debt / nullif(ebit, 0) AS debt_to_ebit, ebit / nullif(revenue, 0) AS margin, cash / nullif(liabilities, 0) AS cash_ratio FROM fundamentals)"


@query("R18_ratios", sql("fundamentals", f", {RATIOS} SELECT symbol, {r(pe='pe', ps='ps', debt_to_ebit='debt_to_ebit', margin='margin', cash_ratio='cash_ratio')} FROM ra"))
def ratios(spark, sf_dir):
    return rounded(x.ratios(m.fundamentals(spark, sf_dir)), "symbol")


def low_sql(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c} ASC NULLS FIRST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count(*) OVER ()"


@query("R19_value_composite", sql("fundamentals", f", {RATIOS}, n AS (SELECT symbol, -pe AS a, -ps AS b, margin AS c FROM ra) SELECT symbol, round(({low_sql('a')} + {low_sql('b')} + {low_sql('c')}) / 3, 6) AS value FROM n"))
def value_composite(spark, sf_dir):
    out = x.percentile_composite(x.ratios(m.fundamentals(spark, sf_dir)), {"pe": -1, "ps": -1, "margin": 1}, "value")
    return rounded(out.select("symbol", "value"), "symbol")


@query("R20_value_traps", sql("fundamentals", f", {RATIOS}, n AS (SELECT symbol, -pe AS a, margin AS c FROM ra), v AS (SELECT symbol, {low_sql('a')} AS value, {low_sql('c')} AS quality FROM n) SELECT symbol, {r(value='value', quality='quality')} FROM v WHERE value > 0.6 AND quality < 0.4"))
def value_traps(spark, sf_dir):
    ra = x.ratios(m.fundamentals(spark, sf_dir))
    out = x.percentile_composite(x.percentile_composite(ra, {"pe": -1}, "value"), {"margin": 1}, "quality")
    return rounded(out.where("value > 0.6 and quality < 0.4").select("symbol", "value", "quality"), "symbol")


@query("R21_altman", sql("fundamentals", """, s AS (SELECT *, liabilities + abs(cash) + ebit AS ta FROM fundamentals), z AS (SELECT symbol, 1.2 * (cash / nullif(ta, 0)) + 1.4 * (ebit * 0.5 / nullif(ta, 0)) + 3.3 * (ebit / nullif(ta, 0)) + 0.6 * (price * shares / nullif(liabilities, 0)) + 1.0 * (revenue / nullif(ta, 0)) AS z FROM s)
SELECT symbol, round(z, 6) AS z, CASE WHEN z > 2.99 THEN 'safe' WHEN z < 1.81 THEN 'distress' ELSE 'grey' END AS zone FROM z"""))
def altman(spark, sf_dir):
    return rounded(x.altman(m.fundamentals(spark, sf_dir)), "symbol")


@query("R22_piotroski", sql("fundamentals", "SELECT symbol, CAST(CAST(ebit > 0 AS INTEGER) + CAST(cash > 0 AS INTEGER) + CAST(cash > ebit AS INTEGER) + CAST(debt < revenue * 0.05 AS INTEGER) + CAST(cash > liabilities * 0.01 AS INTEGER) + CAST(ebit / nullif(revenue, 0) > 0.04 AS INTEGER) + CAST(shares > 0 AS INTEGER) + 2 AS INTEGER) AS f_score FROM fundamentals"))
def piotroski(spark, sf_dir):
    return x.piotroski(m.fundamentals(spark, sf_dir))


@query("R23_growth", sql("bars", f""", y AS (SELECT symbol, CAST(year(date) AS INTEGER) AS year, sum(volume) AS sales FROM bars GROUP BY 1, 2), g AS (SELECT *, sales / nullif(lag(sales) OVER w, 0) - 1 AS growth, first_value(sales) OVER w AS f, row_number() OVER w - 1 AS k, stddev_samp(sales) OVER (PARTITION BY symbol) / nullif(avg(sales) OVER (PARTITION BY symbol), 0) AS cv FROM y WINDOW w AS (PARTITION BY symbol ORDER BY year))
SELECT symbol, year, {r(sales='sales', growth='growth', acceleration='growth - lag(growth) OVER (PARTITION BY symbol ORDER BY year)', cagr='CASE WHEN k > 0 THEN (sales / nullif(f, 0)) ** (1.0 / k) - 1 END', stability='1 / (1 + cv)')} FROM g"""))
def growth(spark, sf_dir):
    return rounded(x.growth(m.daily_bars(spark, sf_dir)), "symbol", "year")


_q = 1.04 / 1.1
_k = _q * (1 - _q**5) / (1 - _q) + _q**5 * 1.02 / 0.08


@query("R24_fair_value", sql("fundamentals", f", v AS (SELECT symbol, price, ebit / nullif(shares, 0) * {_k!r} AS fv FROM fundamentals) SELECT symbol, {r(fair_value='fv', upside='least(fv / nullif(price, 0) - 1, 1.0)')} FROM v"))
def fair_value(spark, sf_dir):
    return rounded(x.fair_value(m.fundamentals(spark, sf_dir)), "symbol")


@query("R26_screener", sql("fundamentals", f", {RATIOS} SELECT symbol, round(margin, 6) AS margin FROM ra WHERE margin > 0.03 AND debt_to_ebit < 2 ORDER BY margin DESC, symbol LIMIT 10"))
def screener(spark, sf_dir):
    ra = x.ratios(m.fundamentals(spark, sf_dir)).where("margin > 0.03 and debt_to_ebit < 2")
    return rounded(ra.select("symbol", "margin").orderBy(F.desc("margin"), "symbol").limit(10), "symbol")


@query("R28_squeeze", sql("ticks", f""", d AS (SELECT symbol, date, sum(CASE WHEN l_returnflag = 'R' THEN quantity ELSE 0.0 END) AS p, sum(CASE WHEN l_returnflag = 'A' THEN quantity ELSE 0.0 END) AS c FROM ticks WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2), q AS (SELECT symbol, date, p / nullif(p + c, 0) AS ratio FROM d),
u AS (SELECT *, CASE WHEN lag(ratio) OVER w IS NOT NULL THEN CAST(ratio > lag(ratio) OVER w AS DOUBLE) END AS up, lag(ratio, 3) OVER w AS r3 FROM q {W})
SELECT symbol, date, round(0.6 * coalesce(ratio, 0.0) + 0.4 * coalesce(ratio - r3, 0.0), 6) AS squeeze, coalesce({roll('avg', 'up', 5)}, 0.0) > 0.6 AS building FROM u"""))
def squeeze(spark, sf_dir):
    return rounded(x.squeeze(a.options_rollup(m.ticks(spark, sf_dir))), "symbol", "date")
