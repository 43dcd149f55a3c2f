"""Queries of cleaning and selection, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import rounded
from ..operators import clean as c
from ..sources import market as m
from .registry import query, sql
from .technical import W, r, r8


def gaps(spark, sf_dir):
    """Bars with holes: every seventh price and every fifth volume of a symbol is null."""
    from ..functions.frames import series

    rn = F.row_number().over(series())
    return m.daily_bars(spark, sf_dir).withColumn("_rn", rn).withColumn("close", F.when(F.col("_rn") % 7 != 0, F.col("close"))).withColumn("volume", F.when(F.col("_rn") % 5 != 0, F.col("volume"))).drop("_rn")


GAPS = f"gaps AS (SELECT symbol, date, open, high, low, CASE WHEN rn % 7 <> 0 THEN close END AS close, CASE WHEN rn % 5 <> 0 THEN volume END AS volume FROM (SELECT *, row_number() OVER w AS rn FROM bars {W}))"


@query("C1_keep_last", sql("ticks", "SELECT symbol, date, round(price, 8) AS price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, quantity DESC) = 1"))
def keep_last(spark, sf_dir):
    return rounded(c.keep_last(m.ticks(spark, sf_dir), ["symbol", "date"], F.desc("place")).select("symbol", "date", "price"), "symbol", "date", digits=8)


@query("C2_robust_clip", sql("bars", """, md AS (SELECT symbol, median(close) AS md FROM bars GROUP BY symbol), d AS (SELECT symbol, median(abs(close - md)) AS d FROM bars JOIN md USING (symbol) GROUP BY symbol)
SELECT symbol, date, round(CASE WHEN d > 0 THEN least(greatest(close, md - 6.0 * 1.4826 * d), md + 6.0 * 1.4826 * d) ELSE close END, 8) AS close FROM bars JOIN md USING (symbol) JOIN d USING (symbol)"""))
def robust_clip(spark, sf_dir):
    return rounded(c.robust_clip(m.daily_bars(spark, sf_dir), ("close",)).select("symbol", "date", "close"), "symbol", "date", digits=8)


@query("C3_winsorize", sql("bars", """, q AS (SELECT symbol, quantile_cont(close, 0.01) AS a, quantile_cont(close, 0.99) AS b FROM bars GROUP BY symbol)
SELECT symbol, date, round(least(greatest(close, a), b), 8) AS close FROM bars JOIN q USING (symbol)"""))
def winsorize(spark, sf_dir):
    return rounded(c.winsorize(m.daily_bars(spark, sf_dir), "close", 0.01, 0.99).select("symbol", "date", "close"), "symbol", "date", digits=8)


@query("C4_enforce_ohlc", sql("bars", f", a AS (SELECT symbol, date, close AS open, high * 0.9 AS high, low * 1.1 AS low, open AS close FROM bars) SELECT symbol, date, {r8(high='greatest(high, open, close)', low='least(low, open, close)')} FROM a"))
def enforce_ohlc(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir).select("symbol", "date", F.col("close").alias("open"), (F.col("high") * 0.9).alias("high"), (F.col("low") * 1.1).alias("low"), F.col("open").alias("close"))
    return rounded(c.enforce_ohlc(bars).select("symbol", "date", "high", "low"), "symbol", "date", digits=8)


@query("C5_fill", sql("bars", f""", {GAPS}, a AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x FROM gaps)
SELECT symbol, date, round(first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 8) AS close FROM a"""))
def fill(spark, sf_dir):
    return rounded(c.fill(gaps(spark, sf_dir), ("close",)).select("symbol", "date", "close"), "symbol", "date", digits=8)


@query("C6_fill_volume", sql("bars", f", {GAPS} SELECT symbol, date, round(coalesce(volume, quantile_cont(volume, 0.5) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0.0), 6) AS volume FROM gaps"))
def fill_volume(spark, sf_dir):
    return rounded(c.fill_volume(gaps(spark, sf_dir)).select("symbol", "date", "volume"), "symbol", "date")


@query("C7_standardise", sql("bars", """, s AS (SELECT avg(close) AS a, stddev_samp(close) AS d FROM bars)
SELECT symbol, date, round(least(greatest((close - a) / CASE WHEN d > 0 THEN d ELSE 1.0 END, -5.0), 5.0), 6) AS close FROM bars, s"""))
def standardise(spark, sf_dir):
    return rounded(c.standardise(m.daily_bars(spark, sf_dir), ("close",)).select("symbol", "date", "close"), "symbol", "date")


@query("C8_scale", sql("bars", f""", s AS (SELECT min(close) AS a, max(close) - min(close) AS b, median(volume) AS v, quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25) AS q FROM bars)
SELECT symbol, date, {r(close_minmax='(close - a) / CASE WHEN b > 0 THEN b ELSE 1.0 END', volume_robust='(volume - v) / CASE WHEN q > 0 THEN q ELSE 1.0 END')} FROM bars, s"""))
def scale(spark, sf_dir):
    return rounded(c.scale(c.scale(m.daily_bars(spark, sf_dir), "close", "minmax"), "volume", "robust").select("symbol", "date", "close_minmax", "volume_robust"), "symbol", "date")


@query("C9_validate", sql("rets", """, a AS (SELECT symbol, count(*) AS n_rows, avg(0.0) AS missing_ratio, count(*) FILTER (least(open, high, low, close) <= 0) AS bad_price, count(*) FILTER (high < low) AS crossed,
count(*) FILTER (volume < 0) AS bad_volume, count(*) FILTER (abs(ret) > 0.5) AS jumps, count(*) - count(DISTINCT date) AS repeated FROM rets GROUP BY symbol)
SELECT *, concat_ws(',', CASE WHEN missing_ratio > 0 THEN 'missing_ratio' END, CASE WHEN bad_price > 0 THEN 'bad_price' END, CASE WHEN crossed > 0 THEN 'crossed' END, CASE WHEN bad_volume > 0 THEN 'bad_volume' END, CASE WHEN jumps > 0 THEN 'jumps' END, CASE WHEN repeated > 0 THEN 'repeated' END) AS issues FROM a"""))
def validate(spark, sf_dir):
    return rounded(c.validate(m.daily_bars(spark, sf_dir)), "symbol")


@query("C11_deduplicate_titles", sql("articles", """, k AS (SELECT id, substring(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' '), 1, 80) AS title_key FROM articles)
SELECT id, title_key FROM k QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY id) = 1"""))
def deduplicate_titles(spark, sf_dir):
    return c.deduplicate_titles(m.articles(spark, sf_dir)).select("id", "title_key")


@query("C11_deduplicate_whole_titles", sql("headlines", """, k AS (SELECT id, substring(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'), ' '), 1, 80) AS title_key FROM headlines)
SELECT id, title_key FROM k QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY id) = 1"""))
def deduplicate_whole_titles(spark, sf_dir):
    """Titles are cut to 80 characters only after normalising."""
    return c.deduplicate_titles(m.headlines(spark, sf_dir)).select("id", "title_key")


@query("C12_latest_fold", sql("bars", ", f AS (SELECT symbol, date, close, fold FROM bars, range(0, 3) AS r(fold) WHERE (symbol + day(date) + fold) % 2 = 0) SELECT symbol, date, CAST(fold AS INTEGER) AS fold, round(close, 8) AS close FROM f QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY fold DESC) = 1"))
def latest_fold(spark, sf_dir):
    folds = m.daily_bars(spark, sf_dir).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((F.col("symbol") + F.dayofmonth("date") + F.col("fold")) % 2 == 0)
    return rounded(c.keep_last(folds, ["symbol", "date"], F.desc("fold")).select("symbol", "date", "fold", "close"), "symbol", "date", digits=8)


@query("C13_recent", sql("disclosures", "SELECT o_orderkey, symbol, date FROM disclosures WHERE date >= (SELECT max(date) - 90 FROM disclosures) AND amount >= 100000"))
def recent(spark, sf_dir):
    return c.recent(m.disclosures(spark, sf_dir), "date", 90, 100000.0).select("o_orderkey", "symbol", "date")


@query("C14_most_liquid", sql("bars", """, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, round(avg(close * volume), 6) AS dollar_volume FROM a WHERE k <= 20 AND n >= 30 GROUP BY symbol ORDER BY avg(close * volume) DESC, symbol LIMIT 20"""))
def most_liquid(spark, sf_dir):
    return rounded(c.most_liquid(m.daily_bars(spark, sf_dir)), "symbol")


@query("C15_daily_mean", "SELECT CAST(ts AS DATE) AS date, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY 1")
def daily_mean(spark, sf_dir):
    return rounded(c.daily_mean(m.table(spark, sf_dir, "events"), "ts", "value"), "date")


@query("C16_lag_signals", sql("bars", f"SELECT symbol, date, {r8(close='coalesce(lag(close) OVER w, 0.0)', volume='coalesce(lag(volume) OVER w, 1.0)')} FROM bars {W}"))
def lag_signals(spark, sf_dir):
    return rounded(c.lag_signals(m.daily_bars(spark, sf_dir), {"close": 0.0, "volume": 1.0}).select("symbol", "date", "close", "volume"), "symbol", "date", digits=8)


@query("C17_align", sql("bars", """, s AS (SELECT symbol, date, close AS signal FROM bars WHERE day(date) % 5 = 0), j AS (SELECT b.symbol, b.date, signal FROM bars b LEFT JOIN s ON b.symbol = s.symbol AND b.date = s.date)
SELECT symbol, date, round(last_value(signal IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 8) AS signal FROM j"""))
def align(spark, sf_dir):
    bars = m.daily_bars(spark, sf_dir)
    sparse = bars.where(F.dayofmonth("date") % 5 == 0).withColumnRenamed("close", "signal")
    return rounded(c.align(sparse, bars.select("symbol", "date"), "signal", 3), "symbol", "date", digits=8)


@query("C19_segment", sql("bars", "SELECT CASE WHEN year(date) <= 1996 THEN 'early' WHEN year(date) <= 1999 THEN 'middle' ELSE 'late' END AS segment, count(*) AS n FROM bars GROUP BY 1"))
def segment(spark, sf_dir):
    label = F.when(F.year("date") <= 1996, "early").when(F.year("date") <= 1999, "middle").otherwise("late")
    return m.daily_bars(spark, sf_dir).groupBy(label.alias("segment")).agg(F.count("*").alias("n"))


@query("C22_split_by_date", sql("bars", """, d AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))
SELECT symbol, date, k <= floor(n * 0.8) AS is_train FROM bars JOIN d USING (date)"""))
def split_by_date(spark, sf_dir):
    return c.split_by_date(m.daily_bars(spark, sf_dir)).select("symbol", "date", "is_train")
