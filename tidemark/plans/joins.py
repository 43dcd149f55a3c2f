"""Queries of joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import div, micros, rounded
from ..operators import joins as j
from ..operators import pairs as pr
from ..sources import market as m
from .registry import query, sql
from .technical import r

FLAGGED = "fl AS (SELECT symbol, date, close FROM bars WHERE day(date) % 7 = 0)"


def flagged(spark, sf_dir):
    return m.daily_bars(spark, sf_dir).where(F.dayofmonth("date") % 7 == 0).select("symbol", "date", "close")


@query("J1_as_of_quotes", sql("trades quotes", """SELECT t.event_id, round(q.bid, 6) AS bid, round(q.ask, 6) AS ask, CAST(epoch_us(t.ts) - epoch_us(q.ts) AS BIGINT) AS staleness_us
FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts"""))
def as_of_quotes(spark, sf_dir):
    out = j.as_of(m.trades(spark, sf_dir), m.quotes(spark, sf_dir).select("symbol", "ts", "bid", "ask"), "ts", ["bid", "ask"])
    return rounded(out.select("event_id", "bid", "ask", (micros("ts") - micros("matched_ts")).alias("staleness_us")), "event_id")


@query("J1_as_of_tolerance", sql("trades quotes", """SELECT t.event_id, round(CASE WHEN epoch_us(t.ts) - epoch_us(q.ts) <= 21600000000 THEN q.bid END, 6) AS bid FROM trades t ASOF LEFT JOIN quotes q ON t.symbol = q.symbol AND t.ts >= q.ts"""))
def as_of_tolerance(spark, sf_dir):
    near = micros("ts") - micros("_on") <= 6 * 3600 * 1_000_000
    return rounded(j.as_of(m.trades(spark, sf_dir), m.quotes(spark, sf_dir).select("symbol", "ts", "bid"), "ts", ["bid"], tolerance=near).select("event_id", "bid"), "event_id")


@query("J2_days_since_event", sql("bars", f", {FLAGGED} SELECT b.symbol, b.date, round(fl.close, 8) AS event_close, CAST(b.date - fl.date AS BIGINT) AS days_since FROM bars b ASOF LEFT JOIN fl ON b.symbol = fl.symbol AND b.date >= fl.date"))
def days_since_event(spark, sf_dir):
    out = j.as_of(m.daily_bars(spark, sf_dir).select("symbol", "date"), flagged(spark, sf_dir).withColumnRenamed("close", "event_close"), "date", ["event_close"])
    return rounded(out.select("symbol", "date", "event_close", F.datediff("date", "matched_date").cast("long").alias("days_since")), "symbol", "date", digits=8)


@query("J3_days_to_event", sql("bars", f", {FLAGGED} SELECT b.symbol, b.date, CAST(fl.date - b.date AS BIGINT) AS days_to FROM bars b ASOF LEFT JOIN fl ON b.symbol = fl.symbol AND b.date <= fl.date"))
def days_to_event(spark, sf_dir):
    out = j.as_of(m.daily_bars(spark, sf_dir).select("symbol", "date"), flagged(spark, sf_dir), "date", ["close"], forward=True)
    return out.select("symbol", "date", F.datediff("matched_date", "date").cast("long").alias("days_to"))


@query("J4_left_on_date", sql("bars disclosures", """, d AS (SELECT symbol, date, sum(amount) AS amount, count(*) AS n FROM disclosures GROUP BY 1, 2)
SELECT b.symbol, b.date, round(amount, 6) AS amount, n FROM bars b LEFT JOIN d ON b.symbol = d.symbol AND b.date = d.date"""))
def left_on_date(spark, sf_dir):
    d = m.disclosures(spark, sf_dir).groupBy("symbol", "date").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))
    return rounded(m.daily_bars(spark, sf_dir).select("symbol", "date").join(d, ["symbol", "date"], "left"), "symbol", "date")


@query("J5_blend_models", sql("rets", """, a AS (SELECT symbol, date, 1 / (1 + exp(-ret)) AS p FROM rets WHERE ret IS NOT NULL), b AS (SELECT symbol, date, volume / 100 AS p FROM bars WHERE volume < 100)
SELECT symbol, date, round((2.0 * a.p + 1.0 * b.p) / 3.0, 6) AS p FROM a JOIN b USING (symbol, date)"""))
def blend_models(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir))
    a = rows.where("ret is not null").select("symbol", "date", (1 / (1 + F.exp(-F.col("ret")))).alias("pa"))
    b = rows.where("volume < 100").select("symbol", "date", (F.col("volume") / 100).alias("pb"))
    return rounded(a.join(b, ["symbol", "date"]).select("symbol", "date", ((2.0 * F.col("pa") + F.col("pb")) / 3.0).alias("p")), "symbol", "date")


@query("J6_market_map", sql("rets", ", mk AS (SELECT date, avg(ret) AS market FROM rets GROUP BY date) SELECT symbol, date, round(ret - market, 6) AS excess FROM rets JOIN mk USING (date)"))
def market_map(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir))
    mk = rows.groupBy("date").agg(F.avg("ret").alias("market"))
    return rounded(rows.join(mk, "date").select("symbol", "date", (F.col("ret") - F.col("market")).alias("excess")), "symbol", "date")


@query("J7_event_in_window", sql("bars", f""", {FLAGGED} SELECT b.symbol, b.date, max(fl.date) AS last_event, count(*) AS n_events FROM bars b JOIN fl ON b.symbol = fl.symbol AND fl.date BETWEEN b.date - 5 AND b.date + 10 GROUP BY b.symbol, b.date"""))
def event_in_window(spark, sf_dir):
    return j.in_window(m.daily_bars(spark, sf_dir).select("symbol", "date"), flagged(spark, sf_dir), 5, 10)


@query("J10_pairs", sql("rets sectors", """, x AS (SELECT symbol, date, industry, ret FROM rets JOIN sectors USING (symbol) WHERE ret IS NOT NULL), p AS (SELECT a.symbol AS a, b.symbol AS b, a.ret AS x, b.ret AS y FROM x a JOIN x b ON a.industry = b.industry AND a.date = b.date AND a.symbol < b.symbol)
SELECT a, b, count(*) AS n, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 6) AS correlation FROM p GROUP BY a, b"""))
def pairs(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).where("ret is not null").join(m.sectors(spark, sf_dir), "symbol")
    return rounded(pr.statistics(rows, "industry", "ret").select("a", "b", "n", "correlation"), "a", "b")


@query("J11_align_with_market", sql("rets", """, b AS (SELECT date, avg(ret) AS other FROM rets GROUP BY date HAVING avg(ret) IS NOT NULL) SELECT symbol, date, round(ret, 6) AS own, round(other, 6) AS other FROM rets JOIN b USING (date) WHERE ret IS NOT NULL"""))
def align_with_market(spark, sf_dir):
    """Every symbol's returns beside the market's on the dates that both have."""
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).where("ret is not null")
    return rounded(rows.select("symbol", "date", F.col("ret").alias("own")).join(rows.groupBy("date").agg(F.avg("ret").alias("other")), "date"), "symbol", "date")


@query("J11_align_two", sql("rets", """, s AS (SELECT date, ret AS own FROM rets WHERE symbol = 1 AND ret IS NOT NULL), b AS (SELECT date, avg(ret) AS other FROM rets GROUP BY date HAVING avg(ret) IS NOT NULL)
SELECT date, round(own, 6) AS own, round(other, 6) AS other FROM s JOIN b USING (date)"""))
def align_two(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).where("ret is not null")
    own = rows.where("symbol = 1").select("date", F.col("ret").alias("own"))
    return rounded(own.join(rows.groupBy("date").agg(F.avg("ret").alias("other")), "date"), "date")


@query("J12_semi_anti", sql("bars disclosures", "SELECT symbol, count(*) AS n FROM bars WHERE symbol IN (SELECT symbol FROM disclosures) AND NOT EXISTS (SELECT 1 FROM disclosures d WHERE d.symbol = bars.symbol AND d.date = bars.date) GROUP BY symbol"))
def semi_anti(spark, sf_dir):
    d = m.disclosures(spark, sf_dir)
    rows = m.daily_bars(spark, sf_dir).join(d.select("symbol"), "symbol", "left_semi").join(d.select("symbol", "date"), ["symbol", "date"], "left_anti")
    return rows.groupBy("symbol").agg(F.count("*").alias("n"))


@query("J13_entry_exit", sql("bars disclosures", """, a AS (SELECT o_orderkey, d.symbol, disclosed + 1 AS entry_from, b.date AS entry_date, b.close AS entry FROM disclosures d ASOF LEFT JOIN bars b ON d.symbol = b.symbol AND d.disclosed + 1 <= b.date)
SELECT o_orderkey, entry_date, round(entry, 8) AS entry, b.date AS exit_date, round(b.close / nullif(entry, 0) - 1, 8) AS gain FROM a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND a.entry_date + 30 >= b.date WHERE entry_date IS NOT NULL"""))
def entry_exit(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir).select("symbol", "date", "close")
    d = m.disclosures(spark, sf_dir).select("o_orderkey", "symbol", F.date_add("disclosed", 1).alias("date"))
    entry = j.as_of(d, bars.withColumnRenamed("close", "entry"), "date", ["entry"], forward=True).where("matched_date is not null").withColumnRenamed("matched_date", "entry_date")
    leave = entry.withColumn("date", F.date_add("entry_date", 30))
    out = j.as_of(leave, bars, "date", ["close"])
    return rounded(out.select("o_orderkey", "entry_date", "entry", F.col("matched_date").alias("exit_date"), (div("close", "entry") - 1).alias("gain")), "o_orderkey", digits=8)


@query("J14_outer_fill", sql("bars", f""", a AS (SELECT date, avg(close) AS x FROM bars WHERE symbol % 2 = 0 GROUP BY date), b AS (SELECT date, avg(close) AS y FROM bars WHERE symbol % 3 = 0 GROUP BY date), s AS (SELECT date FROM a UNION SELECT date FROM b)
SELECT date, {r(x='last_value(x IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)', y='last_value(y IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)')} FROM s LEFT JOIN a USING (date) LEFT JOIN b USING (date)"""))
def outer_fill(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir)
    part = lambda k: bars.where(F.col("symbol") % k == 0).groupBy("date").agg(F.avg("close").alias("value"))
    return rounded(j.outer_fill({"x": part(2), "y": part(3)}), "date")
