"""Queries of event look-ups, text panels, sleeves, risk states, reports, stores and further streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import div, rounded
from ..operators import evaluation as e
from ..operators import signals as g
from ..sources import market as m
from ..sources import store
from ..streaming import events as st
from .portfolio import SCORED, SYM, per_symbol, scored
from .registry import query, sql
from .signals import PAIRS, pair_table
from .technical import W, r, r8, roll

KEYS = ["symbol", "date"]


@query("J9_event_context", sql("disclosures", """, v AS (SELECT symbol, date, max(amount) AS amount FROM disclosures GROUP BY 1, 2), p AS (SELECT symbol, max(date) AS pd, max_by(amount, date) AS pa FROM v WHERE date < DATE '1996-01-01' GROUP BY symbol), n AS (SELECT symbol, min(date) AS nd, min_by(amount, date) AS na FROM v WHERE date >= DATE '1996-01-01' GROUP BY symbol)
SELECT symbol, pd AS previous_date, round(pa, 6) AS previous_amount, nd AS next_date, round(na, 6) AS next_amount, DATE '1996-01-01' - pd AS days_since, nd - DATE '1996-01-01' AS days_to FROM p FULL JOIN n USING (symbol)"""))
def event_context(spark, sf_dir):
    events = m.disclosures(spark, sf_dir).groupBy("symbol", "date").agg(F.max("amount").alias("amount"))
    out = e.event_context(events, "1996-01-01")
    return rounded(out.select("symbol", "previous_date", "previous_amount", "next_date", "next_amount", F.col("days_since").cast("long").alias("days_since"), F.col("days_to").cast("long").alias("days_to")), "symbol")


@query("C23_upcoming_events", sql("disclosures", "SELECT symbol, count(CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1996-01-31' THEN 1 END) AS n_upcoming, min(CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1996-01-31' THEN date END) AS first_upcoming, bool_or(date BETWEEN DATE '1996-01-01' AND DATE '1996-01-31') AS in_window FROM disclosures GROUP BY symbol"))
def upcoming(spark, sf_dir):
    return e.upcoming(m.disclosures(spark, sf_dir), "1996-01-01", 30)


@query("R29_surprises", sql("ticks", """, q AS (SELECT symbol, CAST(date_trunc('quarter', date) AS DATE) AS date, sum(l_extendedprice) AS value FROM ticks GROUP BY 1, 2), x AS (SELECT *, CASE WHEN count(value) OVER v >= 4 THEN avg(value) OVER v END AS est FROM q WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, (value - est) / nullif(abs(est), 0) AS s FROM x), k AS (SELECT symbol, max_by(s, date) AS latest, avg(CAST(s > 0.02 AS DOUBLE)) AS beat_rate, 1 / (1 + coalesce(stddev_samp(s), 0.0)) AS predictability, count(*) AS n FROM s WHERE s IS NOT NULL GROUP BY symbol)
SELECT symbol, n, round(latest, 6) AS latest, round(beat_rate, 6) AS beat_rate, round(predictability, 6) AS predictability, CASE WHEN latest > 0.05 THEN 1 WHEN latest < -0.05 THEN -1 ELSE 0 END AS signal FROM k"""))
def surprises(spark, sf_dir):
    """Quarterly turnover against the mean of the four quarters before."""
    quarters = m.ticks(spark, sf_dir).groupBy("symbol", F.to_date(F.date_trunc("quarter", "date")).alias("date")).agg(F.sum("place.l_extendedprice").alias("value"))
    return rounded(e.surprises(quarters), "symbol", "n")


@query("C18_short_gate", sql("rets sectors", f""", mk AS (SELECT date, avg(ret) AS market FROM rets GROUP BY date), rg AS (SELECT date, CASE WHEN stddev_samp(market) OVER w > 0.8 THEN 'crisis' WHEN sum(market) OVER w < -1 THEN 'bear' WHEN sum(market) OVER w > 1 THEN 'bull' ELSE 'sideways' END AS regime FROM mk WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sg AS (SELECT symbol, date, CAST(coalesce(sign(({roll('avg', 'close', 5)}) - ({roll('avg', 'close', 20)})), 0) AS INTEGER) AS signal FROM bars)
SELECT symbol, date, CASE WHEN sector = 0 AND signal < 0 AND regime NOT IN ('bear', 'crisis') THEN 0 ELSE signal END AS signal FROM sg JOIN rg USING (date) LEFT JOIN sectors USING (symbol)"""))
def short_gate(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir)
    market = m.with_returns(bars).groupBy("date").agg(F.avg("ret").alias("market"))
    return e.short_gate(g.crossover(bars), g.regime(market), m.sectors(spark, sf_dir).where("sector = 0"), ["bear", "crisis"])


@query("A15_ticker_sentiment", sql("articles", """, x AS (SELECT unnest([symbol, (id * 7) % 100]) AS ticker, (n_chars % 200 - 100) / 100.0 AS s, ln(1 + n_chars) AS w FROM articles), t AS (SELECT ticker, count(*) AS mentions, sum(s * w) / nullif(sum(w), 0) AS sentiment FROM x GROUP BY ticker)
SELECT ticker, mentions, round(sentiment, 6) AS sentiment, round((mentions - avg(mentions) OVER ()) / nullif(stddev_pop(mentions) OVER (), 0), 6) AS mention_z FROM t"""))
def ticker_sentiment(spark, sf_dir):
    posts = m.articles(spark, sf_dir).select(F.array("symbol", (F.col("id") * 7) % 100).alias("tickers"), ((F.col("n_chars") % 200 - 100) / 100.0).alias("sentiment"), F.col("n_chars").alias("engagement"))
    return rounded(e.ticker_sentiment(posts), "ticker", "mentions")


def ranged(f: str, x: str, n: int, least: int) -> str:
    return f"({roll(f, x, n, least)})"


@query("W17_tone", sql("articles", f""", d AS (SELECT symbol, date, avg((n_chars % 200) / 10.0 - 10) AS tone FROM articles GROUP BY 1, 2), a AS (SELECT *, {ranged('avg', 'tone', 5, 1)} AS ma_5, {ranged('avg', 'tone', 20, 5)} AS ma_20, {ranged('avg', 'tone', 60, 20)} AS mn, {ranged('stddev_samp', 'tone', 60, 20)} AS sd, {ranged('stddev_samp', 'tone', 20, 5)} AS volatility FROM d),
b AS (SELECT *, CASE WHEN sd > 0.01 THEN (tone - mn) / sd END AS z, ma_5 - ma_20 AS momentum FROM a)
SELECT symbol, date, {r(ma_5='ma_5', ma_20='ma_20', z='z', momentum='momentum', volatility='volatility', acceleration='momentum - lag(momentum) OVER w')}, CAST(CASE WHEN abs(z) > 2 THEN -sign(z) ELSE 0 END AS DOUBLE) AS reversal FROM b {W}"""))
def tone(spark, sf_dir):
    daily = m.articles(spark, sf_dir).groupBy("symbol", "date").agg(F.avg((F.col("n_chars") % 200) / 10.0 - 10).alias("tone"))
    return rounded(e.tone(daily), *KEYS)


IMPLIED = f"""i1 AS (SELECT *, open / nullif(lag(close) OVER w, 0) - 1 AS gap, (high - low) / nullif(close, 0) AS rg, lag(close) OVER w AS pc FROM rets {W}),
i2 AS (SELECT *, (gap - {ranged('avg', 'gap', 20, 10)}) / nullif({ranged('stddev_samp', 'gap', 20, 10)}, 0) AS gap_z, rg / nullif({ranged('avg', 'rg', 20, 10)}, 0) - 1 AS range_surprise, volume / nullif({ranged('avg', 'volume', 20, 10)}, 0) - 1 AS volume_surprise, (close - low) / nullif(high - low, 0) AS place FROM i1),
i3 AS (SELECT symbol, date, ret, gap_z, range_surprise, volume_surprise, tanh(3 * {ranged('avg', 'ret', 10, 5)}) * coalesce(place, 0.5) AS fear_greed, CAST(sign(ret) * sign(volume_surprise) AS DOUBLE) AS divergence, CASE WHEN gap IS NOT NULL THEN CAST(gap > 0 AND low <= pc OR gap < 0 AND high >= pc AS INTEGER) END AS gap_filled FROM i2)"""


@query("W18_implied_sentiment", sql("rets", f", {IMPLIED} SELECT symbol, date, gap_filled, {r(ret='ret', gap_z='gap_z', range_surprise='range_surprise', volume_surprise='volume_surprise', fear_greed='fear_greed', divergence='divergence')} FROM i3"))
def implied_sentiment(spark, sf_dir):
    return rounded(e.implied_sentiment(m.daily_bars(spark, sf_dir)), *KEYS)


@query("W19_training_rows", sql("rets", f""", {IMPLIED}, t AS (SELECT symbol, date, {', '.join(f'lag({c}) OVER w AS {c}_before' for c in ('gap_z', 'range_surprise', 'volume_surprise', 'fear_greed'))}, CASE WHEN lead(ret, 5) OVER w IS NOT NULL THEN exp(sum(ln(1 + greatest(ret, -0.999999))) OVER v) - 1 END AS target FROM i3 WINDOW w AS (PARTITION BY symbol ORDER BY date), v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT symbol, date, {r(**{f'{c}_before': f'{c}_before' for c in ('gap_z', 'range_surprise', 'volume_surprise', 'fear_greed')}, target='target')}, CAST(target > 0 AS INTEGER) AS label FROM t WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ('gap_z_before', 'range_surprise_before', 'volume_surprise_before', 'fear_greed_before', 'target'))}"""))
def training_rows(spark, sf_dir):
    return rounded(e.training_rows(e.implied_sentiment(m.daily_bars(spark, sf_dir)), ["gap_z", "range_surprise", "volume_surprise", "fear_greed"]), *KEYS)


@query("V29_sleeves", sql("rets sectors", """, s AS (SELECT sector AS sleeve, date, avg(ret) AS ret FROM rets JOIN sectors USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2), i AS (SELECT *, CASE WHEN count(ret) OVER w >= 63 THEN 1.0 / nullif(stddev_samp(ret) OVER w, 0) END AS i FROM s WINDOW w AS (PARTITION BY sleeve ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
w AS (SELECT *, least(greatest(i / sum(i) OVER (PARTITION BY date), 0.05), 0.6) AS wt FROM i WHERE i IS NOT NULL) SELECT date, round(sum(wt * ret) / nullif(sum(wt), 0), 6) AS ret, count(*) AS n FROM w GROUP BY date"""))
def sleeves(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).where("ret is not null").join(m.sectors(spark, sf_dir), "symbol").groupBy(F.col("sector").alias("sleeve"), "date").agg(F.avg("ret").alias("ret"))
    return rounded(e.sleeves(rows), "date", "n")


@query("A29_relative_edge", sql("rets", f""", {SYM}, k AS (SELECT symbol, ret - market AS x FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM sym) WHERE k <= 63)
SELECT symbol, count(x) AS n, {r(excess='sum(x)', tracking_error='stddev_pop(x) * sqrt(252.0)', information_ratio='avg(x) * 252 / nullif(stddev_pop(x) * sqrt(252.0), 0)')} FROM k GROUP BY symbol"""))
def relative_edge(spark, sf_dir):
    return rounded(e.relative_edge(per_symbol(spark, sf_dir)), "symbol", "n")


@query("V24_edge_veto", sql("bars", f""", {SCORED}, e AS (SELECT symbol, date, 0.6 * score + 0.4 * (1 - score * score) AS edge FROM scored WHERE score IS NOT NULL), q AS (SELECT quantile_cont(edge, 0.2) AS a FROM e), d AS (SELECT date, quantile_cont(edge, 0.5) AS b FROM e GROUP BY date)
SELECT symbol, date, round(edge, 6) AS edge, edge < a OR edge < b AS vetoed FROM e JOIN d USING (date), q"""))
def edge_veto(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("second", 1 - F.col("score") * F.col("score"))
    return rounded(e.veto(rows, ("score", "second"), 0.2, 0.5), *KEYS)


@query("V25_slot_long_short", sql("trades", """, x AS (SELECT symbol, ts, event_id, price / nullif(lag(price) OVER w, 0) - 1 AS back, lead(price) OVER w / nullif(price, 0) - 1 AS ahead FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)), l AS (SELECT symbol, date_trunc('hour', ts) AS slot, max_by(back, (ts, event_id)) AS back, max_by(ahead, (ts, event_id)) AS ahead FROM x WHERE back IS NOT NULL AND ahead IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY back DESC, symbol) AS h, row_number() OVER (PARTITION BY slot ORDER BY back, symbol) AS lo, count(*) OVER (PARTITION BY slot) AS n FROM l)
SELECT epoch(slot)::BIGINT AS slot, round(avg(CASE WHEN h <= 2 THEN ahead END) - avg(CASE WHEN lo <= 2 THEN ahead END) - 0.001, 6) AS ret FROM k WHERE n >= 4 GROUP BY slot"""))
def slot_long_short(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    rows = m.trades(spark, sf_dir).withColumn("back", div("price", F.lag("price").over(w)) - 1).withColumn("ahead", div(F.lead("price").over(w), "price") - 1).where("back is not null and ahead is not null")
    place = F.struct("ts", "event_id")
    slots = rows.groupBy("symbol", F.date_trunc("hour", "ts").alias("hour")).agg(F.max_by("back", place).alias("back"), F.max_by("ahead", place).alias("ahead"))
    slots = slots.withColumn("slot", F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("hour").cast("timestamp_ntz")))
    return rounded(e.slot_long_short(slots, "back", "ahead", 2, 0.0005), "slot")


@query("V37_prediction_check", sql("bars", f""", {SCORED}, x AS (SELECT date, score - 0.5 AS e, forward_return AS f FROM scored WHERE score IS NOT NULL AND forward_return IS NOT NULL)
SELECT date, count(*) AS n, {r(hit_rate='avg(CAST(sign(e) = sign(f) AS DOUBLE))', weighted_return='sum(e * f) / nullif(sum(abs(e)), 0)')} FROM x GROUP BY date"""))
def prediction_check(spark, sf_dir):
    return rounded(e.prediction_check(scored(spark, sf_dir), "score", "forward_return"), "date", "n")


@query("V40_fill_statistics", """WITH f AS (SELECT l_orderkey AS "order", count(*) AS n_fills, sum(l_quantity) AS filled, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS average_price, max(30.0 + l_orderkey % 150) AS wanted FROM lineitem WHERE l_quantity <> 0 GROUP BY 1)
SELECT "order", n_fills, round(filled, 10) AS filled, CAST(wanted AS DOUBLE) AS wanted, floor(average_price * 1000000 + 0.5001) / 1000000 AS average_price, round(filled / nullif(wanted, 0), 10) AS fill_rate, CASE WHEN filled <= 0 THEN 'empty' WHEN filled / nullif(wanted, 0) < 1 THEN 'partial' WHEN filled / nullif(wanted, 0) > 1 THEN 'overfilled' ELSE 'filled' END AS reason FROM f""")
def fill_statistics(spark, sf_dir):
    rows = m.table(spark, sf_dir, "lineitem").where("l_quantity <> 0").select(F.col("l_orderkey").alias("order"), F.col("l_quantity").cast("double").alias("quantity"), (30.0 + F.col("l_orderkey") % 150).alias("wanted"), F.col("l_extendedprice").cast("double").alias("amount"))
    # Prices over quantities often end in a 5 that engines round differently; a little more than a half sends it up in both.
    out = e.fills(rows).withColumn("average_price", F.floor(F.col("average_price") * 1000000 + 0.5001) / 1000000)
    return rounded(out, "order", "n_fills", digits=10)


WINDOWS = [("first year", "1995-01-01", "1995-12-31"), ("middle years", "1996-01-01", "1998-12-31"), ("late years", "1999-01-01", "2002-12-31")]


@query("V45_stress_windows", sql("rets", f""", mk AS (SELECT date, avg(ret) AS ret FROM rets WHERE ret IS NOT NULL GROUP BY date), wn AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WINDOWS)}) AS t(name, a, b)),
x AS (SELECT name, date, ret, sum(ln(1 + greatest(ret, -0.999999))) OVER (PARTITION BY name ORDER BY date) AS g FROM mk JOIN wn ON date BETWEEN a AND b), y AS (SELECT *, g - greatest(max(g) OVER (PARTITION BY name ORDER BY date), 0.0) AS f FROM x)
SELECT name, count(*) AS n, {r(growth='sum(ln(1 + greatest(ret, -0.999999)))', deviation='stddev_samp(ret)', largest_fall='exp(min(f)) - 1')}, exp(min(f)) - 1 >= -0.5 AS passes FROM y GROUP BY name"""))
def stress_windows(spark, sf_dir):
    market = m.with_returns(m.daily_bars(spark, sf_dir)).where("ret is not null").groupBy("date").agg(F.avg("ret").alias("ret"))
    return rounded(e.stress_windows(market, WINDOWS, -0.5), "name", "n")


@query("V42_correlation_regime", sql("bars sectors", f""", {PAIRS}, c AS (SELECT industry, correlation FROM ps JOIN sectors ON ps.a = sectors.symbol)
SELECT industry, count(correlation) AS n, round(avg(correlation), 6) AS mean_correlation, count(CASE WHEN abs(correlation) > 0.2 THEN 1 END) AS alerts, CASE WHEN avg(correlation) > 0.05 THEN 'high' WHEN avg(correlation) < 0 THEN 'low' ELSE 'normal' END AS regime FROM c GROUP BY industry"""))
def correlation_regime(spark, sf_dir):
    # The plan cannot tell how many pairs a tile gives, so it is told which side is small.
    pairs = pair_table(spark, sf_dir).join(F.broadcast(m.sectors(spark, sf_dir).select(F.col("symbol").alias("a"), "industry")), "a")
    return rounded(e.correlation_regime(pairs, "industry"), "industry", "n", "alerts")


@query("M39_histogram", sql("rets", """, x AS (SELECT symbol, ret, min(ret) OVER v AS a, max(ret) OVER v AS b, count(*) OVER v AS k FROM rets WHERE ret IS NOT NULL WINDOW v AS (PARTITION BY symbol)), y AS (SELECT *, CAST(coalesce(least(floor((ret - a) / nullif(b - a, 0) * 20), 19), 0) AS INTEGER) AS bin FROM x)
SELECT symbol, bin, count(*) AS n, round(count(*) * max(1.0 / nullif(k * (b - a) / 20, 0)), 6) AS density FROM y GROUP BY symbol, bin"""))
def histogram(spark, sf_dir):
    return rounded(e.histogram(m.with_returns(m.daily_bars(spark, sf_dir)), "symbol", "ret", 20), "symbol", "bin", "n")


@query("R25_quality_points", sql("fundamentals", f""", x AS (SELECT *, ebit / nullif(revenue, 0) AS mg, debt / nullif(revenue, 0) AS ds, ebit / nullif(debt, 0) AS cv, (revenue / nullif(shares, 0)) / nullif(price, 0) AS worth FROM fundamentals)
SELECT symbol, {r(margin='mg', debt_share='ds', coverage='cv', net_debt_to_ebit='(debt - cash) / nullif(ebit, 0)', return_on_capital='ebit / nullif(liabilities + cash, 0)')}, CASE WHEN mg > 0.045 THEN 3 WHEN mg > 0.04 THEN 2 WHEN mg > 0.03 THEN 1 ELSE 0 END + CASE WHEN ds < 0.045 THEN 2 WHEN ds < 0.055 THEN 1 ELSE 0 END + CASE WHEN cv > 1 THEN 2 WHEN cv > 0.8 THEN 1 ELSE 0 END + CASE WHEN cash > 5000 THEN 2 WHEN cash > 0 THEN 1 ELSE 0 END AS quality_points, CASE WHEN worth > 0.04 THEN 2 WHEN worth > 0.02 THEN 1 ELSE 0 END AS value_points FROM x"""))
def quality_points(spark, sf_dir):
    """Also R34: margin, coverage, net debt to operating profit and return on capital."""
    return rounded(e.quality_points(m.fundamentals(spark, sf_dir)), "symbol")


@query("A28_session_profit", sql("bars", f"SELECT symbol, date, {r8(profit='close - first_value(close) OVER w', return_percent='100 * (close / nullif(first_value(close) OVER w, 0) - 1)', change='close - lag(close) OVER w')} FROM bars {W}"))
def session_profit(spark, sf_dir):
    return rounded(e.session_profit(m.daily_bars(spark, sf_dir)), *KEYS, digits=8)


@query("V18_candidate_score", sql("rets", f""", {SYM}, g AS (SELECT symbol, CASE WHEN year(date) < 1997 THEN 'early' WHEN year(date) < 1999 THEN 'middle' ELSE 'late' END AS segment, avg(ret - market) AS excess FROM sym GROUP BY 1, 2)
SELECT symbol, round(0.2 * coalesce(max(CASE WHEN segment = 'early' THEN excess END), 0.0) + 0.3 * coalesce(max(CASE WHEN segment = 'middle' THEN excess END), 0.0) + 0.5 * coalesce(max(CASE WHEN segment = 'late' THEN excess END), 0.0), 6) AS score, round(min(excess), 6) AS worst FROM g GROUP BY symbol"""))
def candidate_score(spark, sf_dir):
    year = F.year("date")
    rows = per_symbol(spark, sf_dir).groupBy("symbol", F.when(year < 1997, "early").when(year < 1999, "middle").otherwise("late").alias("segment")).agg(F.avg(F.col("ret") - F.col("market")).alias("excess"))
    return rounded(e.candidate_score(rows, {"early": 0.2, "middle": 0.3, "late": 0.5}), "symbol")


@query("S4_domain_slice", sql("bars", "SELECT symbol, date, round(close, 8) AS close, volume FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1999-06-30'"))
def domain_slice(spark, sf_dir):
    """Also S2: all bars are saved by year, then a range of dates is read, which prunes years."""
    rows = m.daily_bars(spark, sf_dir).select(*KEYS, "close", "volume")
    path = store.scratch(spark, "bars")
    store.save_domain(rows.withColumn("year", F.year("date")), path, by="year")
    back = store.load_domain(spark, path, rows.withColumn("year", F.year("date")).schema, "1996-03-01", "1999-06-30", years=True)
    return rounded(back.select(*KEYS, "close", "volume"), *KEYS, digits=8)


@query("S14_ledger", sql("bars", "SELECT symbol, CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM bars GROUP BY 1, 2"))
def ledger(spark, sf_dir):
    """Also S7: yearly counts are appended to a ledger of JSON lines, even and odd years apart, and read back by the name's ending."""
    rows = m.daily_bars(spark, sf_dir).groupBy("symbol", F.year("date").alias("year")).agg(F.count("*").alias("n"))
    path = store.scratch(spark, "ledger") + ".jsonl"
    for odd in (0, 1):
        store.append_ledger(rows.where(F.col("year") % 2 == odd), path)
    return store.read_any(spark, path, rows.schema)


@query("T9_stream_flow_by_second", sql("trades", "SELECT epoch(date_trunc('second', ts))::BIGINT AS second, count(*) AS n, round(sum(side * volume), 6) AS flow FROM trades GROUP BY 1"))
def stream_flow(spark, sf_dir):
    out = st.run_once(st.flow_by_second(st.source(spark, sf_dir)), "complete")
    return rounded(out.select(F.unix_timestamp("w.start").alias("second"), "n", "flow"), "second", "n")


@query("T3_stream_sliding_features", f"SELECT user_id, CAST(ts AS DATE) - CAST(k AS INTEGER) AS day, count(*) AS n, {r(mean='avg(value)', low='min(value)', high='max(value)')} FROM events, range(0, 3) AS s(k) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    out = st.run_once(st.sliding(st.source(spark, sf_dir)), "complete")
    return rounded(out.select("user_id", F.to_date("w.start").alias("day"), "n", "mean", "low", "high"), "user_id", "day", "n")


@query("T4_stream_prevailing_quotes", "SELECT user_id, CAST(ts AS DATE) AS day, round(max_by(value, (ts, event_id)), 6) AS mid, max_by(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2")
def stream_quotes(spark, sf_dir):
    out = st.run_once(st.prevailing_quotes(st.source(spark, sf_dir)), "complete")
    return rounded(out.select("user_id", F.to_date("w.start").alias("day"), "mid", "event_id"), "user_id", "day", "event_id")


@query("T6_stream_universe", "SELECT user_id, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS volume FROM events WHERE event_type = 'purchase' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def stream_universe(spark, sf_dir):
    return rounded(st.liquid_universe(st.source(spark, sf_dir), store.scratch(spark, "universe"), 20), "user_id")


@query("T11_stream_anchor", """WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS anchor FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT event_id, user_id, day, round(anchor, 6) AS anchor FROM (SELECT e.event_id, e.user_id, a.day, a.anchor, row_number() OVER (PARTITION BY e.event_id ORDER BY a.day DESC) AS k FROM events e LEFT JOIN a ON e.user_id = a.user_id AND a.day = CAST(e.ts AS DATE) - 1)""")
def stream_anchor(spark, sf_dir):
    """Yesterday's mean of a user's clicks beside each event."""
    rows = m.table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("anchor"))
    return rounded(st.run_once(st.with_anchor(st.source(spark, sf_dir), rows, 0)), "event_id", "user_id", "day")

