"""Queries of aggregations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import micros, rounded
from ..operators import aggregates as a

from ..sources import market as m
from .registry import query, sql
from .technical import last, r, r8, roll


@query("A1_resample", sql("bars", f""", p AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS period, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)
SELECT symbol, period, {r8(open='open', high='high', low='low', close='close', volume='volume', ret='close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY period), 0) - 1')} FROM p"""))
def resample(spark, sf_dir):
    return rounded(a.resample(m.daily_bars(spark, sf_dir)), "symbol", "period", digits=8)


@query("A2_order_flow", sql("trades", f""", b AS (SELECT symbol, time_bucket(INTERVAL 1 DAY, ts) AS bucket, sum(side * volume) AS ofi, count(*) AS n_trades FROM trades GROUP BY 1, 2)
SELECT symbol, CAST(bucket AS DATE) AS bucket_date, n_trades, {r(ofi='ofi', ofi_cum='sum(ofi) OVER (PARTITION BY symbol ORDER BY bucket)', ofi_mean='avg(ofi) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')} FROM b"""))
def order_flow(spark, sf_dir):
    out = a.order_flow(m.trades(spark, sf_dir))
    return rounded(out.select("symbol", F.to_date("bucket").alias("bucket_date"), "n_trades", "ofi", "ofi_cum", "ofi_mean"), "symbol", "bucket_date", "n_trades")


@query("A3_last_quotes", sql("quotes", f"SELECT symbol, CAST(ts AS DATE) AS bucket_date, {r(bid='last(bid ORDER BY ts, event_id)', ask='last(ask ORDER BY ts, event_id)')} FROM quotes GROUP BY 1, 2"))
def last_quotes(spark, sf_dir):
    return rounded(a.last_quotes(m.quotes(spark, sf_dir)).select("symbol", F.to_date("bucket").alias("bucket_date"), "bid", "ask"), "symbol", "bucket_date")


@query("A4_depth_summary", sql("depth", f"""SELECT symbol, epoch_us(ts) AS us, {r(bid_depth='sum(bid_size)', ask_depth='sum(ask_size)', bid_slope='regr_slope(bid_size, level)', top_bid='arg_min(bid_size, level)', top_ask='arg_min(ask_size, level)', imbalance='(sum(bid_size) - sum(ask_size)) / nullif(sum(bid_size) + sum(ask_size), 0)')} FROM depth GROUP BY symbol, ts"""))
def depth_summary(spark, sf_dir):
    out = a.depth_summary(m.depth(spark, sf_dir)).withColumn("us", micros("ts")).drop("ts")
    return rounded(out, "symbol", "us")


@query("A5_vpin", sql("bars", """, c AS (SELECT *, CAST(floor((sum(volume) OVER (PARTITION BY symbol ORDER BY date) - volume) / 500.0) AS BIGINT) AS bucket FROM bars)
SELECT symbol, bucket, min(date) AS start_date, round(abs(2 * sum(CASE WHEN close >= open THEN volume ELSE 0.0 END) - sum(volume)) / nullif(sum(volume), 0), 6) AS vpin FROM c GROUP BY symbol, bucket"""))
def vpin(spark, sf_dir):
    return rounded(a.vpin(m.daily_bars(spark, sf_dir), 500.0), "symbol", "bucket")


@query("A6_peer_stats", sql("rets sectors", f""", x AS (SELECT symbol, date, sector, ret FROM rets JOIN sectors USING (symbol))
SELECT symbol, date, {r(peer_mean='avg(ret) OVER w', peer_dispersion='stddev_pop(ret) OVER w', peer_ex_self='CASE WHEN count(ret) OVER w > 1 AND ret IS NOT NULL THEN (sum(ret) OVER w - ret) / (count(ret) OVER w - 1) END')} FROM x WINDOW w AS (PARTITION BY date, sector)"""))
def peer_stats(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir)).join(m.sectors(spark, sf_dir), "symbol")
    return rounded(a.peer_stats(rows, "ret", "sector").select("symbol", "date", "peer_mean", "peer_dispersion", "peer_ex_self"), "symbol", "date")


@query("A7_market", sql("rets", "SELECT date, round(avg(ret), 6) AS market, count(ret) AS n FROM rets GROUP BY date"))
def market(spark, sf_dir):
    return rounded(a.market(m.with_returns(m.daily_bars(spark, sf_dir))), "date")


@query("A8_weighted_profile", sql("rets", "SELECT date, round(sum((1.0 + symbol % 3) * ret) / nullif(sum(1.0 + symbol % 3), 0), 6) AS profile, count(*) AS n FROM rets WHERE symbol % 2 = 0 AND ret IS NOT NULL GROUP BY date"))
def weighted_profile(spark, sf_dir):
    rows = m.with_returns(m.daily_bars(spark, sf_dir))
    weights = m.sectors(spark, sf_dir).where("symbol % 2 = 0").select("symbol", (1.0 + F.col("symbol") % 3).alias("weight"))
    return rounded(a.weighted_profile(rows, weights), "date")


@query("A9_daily_sentiment", sql("mentions", f", d AS (SELECT symbol, CAST(ts AS DATE) AS date, avg(sentiment) AS sentiment, sum(volume) AS volume FROM mentions GROUP BY 1, 2) SELECT symbol, date, {r(sentiment='sentiment', volume='volume', sentiment_mean=roll('avg', 'sentiment', 3, 1))} FROM d"))
def daily_sentiment(spark, sf_dir):
    return rounded(a.daily_sentiment(m.mentions(spark, sf_dir)), "symbol", "date")


@query("A10_article_features", sql("articles", f""", s AS (SELECT *, least(greatest((n_chars - 2000) / 2000.0, -1.0), 1.0) AS score, CASE WHEN regexp_matches(source, '[02468]$') THEN 2.0 ELSE 1.0 END AS w FROM articles)
SELECT symbol, date, count(*) AS n, {r(mean='avg(score)', std='stddev_samp(score)', max='max(score)', min='min(score)', positive_share='avg(CAST(score > 0.1 AS DOUBLE))', weighted_mean='sum(w * score) / nullif(sum(w), 0)', confident_mean='avg(CASE WHEN abs(score) > 0.7 THEN score END)')} FROM s GROUP BY symbol, date"""))
def article_features(spark, sf_dir):
    return rounded(a.article_features(m.articles(spark, sf_dir)), "symbol", "date")


@query("A11_insider_sentiment", sql("disclosures", f""", s AS (SELECT symbol, count(*) FILTER (kind = 'buy') AS n_buys, count(*) FILTER (kind = 'sell') AS n_sells, sum(CASE WHEN kind = 'buy' THEN amount ELSE 0.0 END) AS b, sum(CASE WHEN kind = 'sell' THEN amount ELSE 0.0 END) AS s FROM disclosures GROUP BY symbol)
SELECT symbol, n_buys, n_sells, {r(buy_value='b', sell_value='s', sentiment='(b - s) / (b + s + 1)')} FROM s"""))
def insider_sentiment(spark, sf_dir):
    return rounded(a.insider_sentiment(m.disclosures(spark, sf_dir)), "symbol")


@query("A12_cluster_score", sql("disclosures", f""", b AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS l FROM disclosures WHERE kind = 'buy')
SELECT symbol, count(DISTINCT name) AS n_insiders, {r(value='sum(amount)', cluster_score='ln(1 + count(DISTINCT name)) * ln(1 + sum(amount) / 1e5)')} FROM b WHERE date >= l - 14 GROUP BY symbol"""))
def cluster_score(spark, sf_dir):
    return rounded(a.cluster_score(m.disclosures(spark, sf_dir)), "symbol")


@query("A13_congress_sentiment", sql("disclosures", f"SELECT symbol, count(*) AS n_trades, {r(sentiment=chr(39).join(['sum(CASE kind WHEN ', 'buy', ' THEN 1.0 WHEN ', 'sell', ' THEN -1.0 ELSE 0.0 END * amount) / nullif(sum(amount), 0)']), confidence='least(count(*) / 5.0, 1.0)')} FROM disclosures GROUP BY symbol"))
def congress_sentiment(spark, sf_dir):
    return rounded(a.congress_sentiment(m.disclosures(spark, sf_dir)), "symbol")


@query("A14_good_traders", sql("disclosures", "SELECT name, count(*) AS n, round(avg(amount / 100000 - 1), 6) AS mean_gain FROM disclosures GROUP BY name HAVING count(*) >= 5 AND avg(amount / 100000 - 1) > 0.05"))
def good_traders(spark, sf_dir):
    return rounded(a.good_traders(m.disclosures(spark, sf_dir).withColumn("gain", F.col("amount") / 100000 - 1)), "name")


@query("A16_market_sentiment", sql("mentions", f"SELECT CAST(ts AS DATE) AS date, {r(weighted='sum(volume * sentiment) / nullif(sum(volume), 0)', bull='avg(CAST(sentiment > 0.1 AS DOUBLE))', bear='avg(CAST(sentiment < -0.1 AS DOUBLE))')} FROM mentions GROUP BY 1"))
def market_sentiment(spark, sf_dir):
    from ..functions.frames import div

    out = m.mentions(spark, sf_dir).groupBy(F.to_date("ts").alias("date")).agg(div(F.sum(F.col("volume") * F.col("sentiment")), F.sum("volume")).alias("weighted"), F.avg((F.col("sentiment") > 0.1).cast("double")).alias("bull"), F.avg((F.col("sentiment") < -0.1).cast("double")).alias("bear"))
    return rounded(out, "date")


@query("A17_trending", sql("mentions", "SELECT symbol, count(*) AS n_mentions, round(avg(sentiment), 6) AS sentiment FROM mentions GROUP BY symbol HAVING count(*) >= 3 ORDER BY count(*) DESC, symbol LIMIT 10"))
def trending(spark, sf_dir):
    return rounded(a.trending(m.mentions(spark, sf_dir), 3, 10), "symbol")


@query("A18_options_rollup", sql("ticks", f""", d AS (SELECT symbol, date, sum(CASE WHEN l_returnflag = 'R' THEN quantity ELSE 0.0 END) AS p, sum(CASE WHEN l_returnflag = 'A' THEN quantity ELSE 0.0 END) AS c, avg(l_tax) - avg(l_discount) AS iv_skew FROM ticks WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2), e AS (SELECT *, p + c AS t FROM d)
SELECT symbol, date, {r(put_volume='p', call_volume='c', iv_skew='iv_skew', pc_ratio='p / nullif(c, 0)', total_volume='t', volume_z=f"(t - ({roll('avg', 't', 20)})) / nullif({roll('stddev_samp', 't', 20)}, 0)")} FROM e"""))
def options_rollup(spark, sf_dir):
    return rounded(a.options_rollup(m.ticks(spark, sf_dir)), "symbol", "date")


@query("A19_insider_rollup", sql("bars disclosures", f""", d AS (SELECT symbol, date, sum(CASE kind WHEN 'buy' THEN amount WHEN 'sell' THEN -amount ELSE 0.0 END) AS net, sum(amount) AS gross, count(*) AS n FROM disclosures GROUP BY 1, 2),
j AS (SELECT b.symbol, b.date, coalesce(net, 0.0) AS net, coalesce(gross, 0.0) AS gross, coalesce(n, 0) AS n FROM bars b LEFT JOIN d ON b.symbol = d.symbol AND b.date = d.date)
SELECT symbol, date, round(sum(net) OVER {last(90)} / (sum(gross) OVER {last(90)} + 1), 6) AS value_sentiment, CAST(sum(n) OVER {last(14)} AS BIGINT) AS recent_count FROM j"""))
def insider_rollup(spark, sf_dir):
    return rounded(a.trailing_rollup(m.disclosures(spark, sf_dir), m.daily_bars(spark, sf_dir)), "symbol", "date")


@query("A20_congress_rollup", sql("bars disclosures", f""", d AS (SELECT symbol, disclosed AS date, sum(CASE kind WHEN 'buy' THEN amount WHEN 'sell' THEN -amount ELSE 0.0 END) AS net, sum(amount) AS gross, count(*) AS n FROM disclosures GROUP BY 1, 2),
j AS (SELECT b.symbol, b.date, coalesce(net, 0.0) AS net, coalesce(gross, 0.0) AS gross, coalesce(n, 0) AS n FROM bars b LEFT JOIN d ON b.symbol = d.symbol AND b.date = d.date)
SELECT symbol, date, round(sum(net) OVER {last(90)} / (sum(gross) OVER {last(90)} + 1), 6) AS value_sentiment, CAST(sum(n) OVER {last(90)} AS BIGINT) AS recent_count FROM j"""))
def congress_rollup(spark, sf_dir):
    rows = m.disclosures(spark, sf_dir).drop("date").withColumnRenamed("disclosed", "date")
    return rounded(a.trailing_rollup(rows, m.daily_bars(spark, sf_dir), counts=90), "symbol", "date")


@query("A21_coverage", sql("bars disclosures", """, d AS (SELECT DISTINCT symbol, date, 1 AS has FROM disclosures), j AS (SELECT b.*, has FROM bars b LEFT JOIN d ON b.symbol = d.symbol AND b.date = d.date), e AS (SELECT max(date) AS e FROM bars)
SELECT 'filings' AS domain, round(avg(CAST(has IS NOT NULL AS DOUBLE)), 6) AS coverage, max(CASE WHEN has IS NOT NULL THEN date END) AS latest, CAST(max(e) - max(CASE WHEN has IS NOT NULL THEN date END) AS INTEGER) AS staleness FROM j, e
UNION ALL SELECT 'price', round(avg(CAST(close IS NOT NULL AS DOUBLE)), 6), max(date), CAST(max(e) - max(date) AS INTEGER) FROM j, e"""))
def coverage(spark, sf_dir):
    d = m.disclosures(spark, sf_dir).select("symbol", "date").distinct().withColumn("has", F.lit(1))
    return rounded(a.coverage(m.daily_bars(spark, sf_dir).join(d, ["symbol", "date"], "left"), {"filings": "has", "price": "close"}), "domain")


@query("A22_flow_by_second", sql("trades", "SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second, round(sum(side * volume * price), 6) AS flow FROM trades GROUP BY 1"))
def flow_by_second(spark, sf_dir):
    out = m.trades(spark, sf_dir).groupBy(F.floor(micros("ts") / 1_000_000).alias("second")).agg(F.sum(F.col("side") * F.col("volume") * F.col("price")).alias("flow"))
    return rounded(out, "second")


@query("A23_positions", f"""WITH f AS (SELECT l_suppkey AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, l_quantity AS q, l_extendedprice / nullif(l_quantity, 0) AS p, l_tax * l_extendedprice AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT symbol, {r(net_quantity='sum(side * q)', cost='sum(side * q * p)', commission='sum(c)', avg_price='sum(q * p) / nullif(sum(q), 0)')} FROM f GROUP BY symbol""")
def positions(spark, sf_dir):
    from ..functions.frames import div

    rows = m.table(spark, sf_dir, "lineitem").join(m.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    fills = rows.select(F.col("l_suppkey").alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("side"), F.col("l_quantity").alias("quantity"), div("l_extendedprice", "l_quantity").alias("price"), (F.col("l_tax") * F.col("l_extendedprice")).alias("commission"))
    return rounded(a.positions(fills), "symbol")


@query("A25_block_returns", sql("rets", """, k AS (SELECT symbol, date, ret, avg(ret) OVER (PARTITION BY date) AS market, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM rets),
b AS (SELECT *, CAST(floor((k - n % 20) / 20.0) AS BIGINT) AS block FROM k WHERE k - n % 20 >= 0), c AS (SELECT symbol, block, exp(sum(ln(1 + greatest(coalesce(ret, 0.0), -0.999999)))) - 1 AS r, exp(sum(ln(1 + greatest(coalesce(market, 0.0), -0.999999)))) - 1 AS mr FROM b GROUP BY 1, 2)
SELECT symbol, block, round(least(r, 1000.0), 6) AS block_return, round(least(mr, 1000.0), 6) AS market_return, r > mr AS beats FROM c"""))
def block_returns(spark, sf_dir):
    from ..functions.frames import across

    rows = m.with_returns(m.daily_bars(spark, sf_dir)).withColumn("market", F.avg("ret").over(across("date")))
    out = a.block_returns(rows, 20)
    # This query reports returns up to 1000; A25_block_growth reports the logarithm of all.
    return rounded(out.withColumns({c: F.least(c, F.lit(1000.0)) for c in ("block_return", "market_return")}), "symbol", "block")


@query("A25_block_growth", sql("rets", """, k AS (SELECT symbol, date, ret, avg(ret) OVER (PARTITION BY date) AS market, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM rets),
b AS (SELECT *, CAST(floor((k - n % 126) / 126.0) AS BIGINT) AS block FROM k WHERE k - n % 126 >= 0)
SELECT symbol, block, round(sum(ln(1 + greatest(coalesce(ret, 0.0), -0.999999))), 6) AS block_growth, round(sum(ln(1 + greatest(coalesce(market, 0.0), -0.999999))), 6) AS market_growth FROM b GROUP BY 1, 2"""))
def block_growth(spark, sf_dir):
    from ..functions.frames import across

    rows = m.with_returns(m.daily_bars(spark, sf_dir)).withColumn("market", F.avg("ret").over(across("date")))
    out = a.block_returns(rows)
    return rounded(out.select("symbol", "block", F.log1p("block_return").alias("block_growth"), F.log1p("market_return").alias("market_growth")), "symbol", "block")


@query("A26_yearly", sql("rets", f"SELECT CAST(year(date) AS INTEGER) AS year, count(ret) AS n, {r(mean='avg(ret)', std='stddev_samp(ret)', win_rate='avg(CAST(ret > 0 AS DOUBLE))')} FROM rets GROUP BY 1"))
def yearly(spark, sf_dir):
    return rounded(a.yearly(m.with_returns(m.daily_bars(spark, sf_dir))), "year")


@query("A27_grid", sql("rets sectors", f"SELECT sector, {r(mean='avg(ret)', p10='quantile_cont(ret, 0.1)', p50='quantile_cont(ret, 0.5)', p90='quantile_cont(ret, 0.9)', win_probability='avg(CAST(ret > 0 AS DOUBLE))')} FROM rets JOIN sectors USING (symbol) GROUP BY sector"))
def grid(spark, sf_dir):
    return rounded(a.grid(m.with_returns(m.daily_bars(spark, sf_dir)).join(m.sectors(spark, sf_dir), "symbol"), "sector", "ret"), "sector")
