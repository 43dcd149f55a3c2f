"""Aggregations of ticks, mentions, articles and disclosures into panel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr


def resample(bars: DataFrame, unit: str = "month") -> DataFrame:
    """Bars of a longer period: first open, max high, min low, last close, summed volume, and returns."""
    out = bars.groupBy("symbol", F.trunc("date", unit).alias("period")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumn("ret", fr.change("close", order="period"))


def order_flow(trades: DataFrame, minutes: int = 1440, mean: int = 5) -> DataFrame:
    """Signed volume per time bucket, its running sum and mean."""
    start = F.window("ts", f"{minutes} minutes").start
    out = trades.groupBy("symbol", start.alias("bucket")).agg(F.sum(F.col("side") * F.col("volume")).alias("ofi"), F.count("*").alias("n_trades"))
    return out.withColumn("ofi_cum", F.sum("ofi").over(fr.so_far("symbol", "bucket"))).withColumn("ofi_mean", fr.rolling("mean", "ofi", mean, 1, order="bucket"))


def last_quotes(quotes: DataFrame, minutes: int = 1440) -> DataFrame:
    """The last quote of each time bucket with one, and the mid carried on."""
    last = F.max_by(F.struct("bid", "ask"), F.struct("ts", "event_id"))
    out = quotes.groupBy("symbol", F.window("ts", f"{minutes} minutes").start.alias("bucket")).agg(last.alias("q"))
    return out.select("symbol", "bucket", "q.bid", "q.ask", ((F.col("q.bid") + F.col("q.ask")) / 2).alias("mid"))


def depth_summary(depth: DataFrame) -> DataFrame:
    """Total sizes of a snapshot, slope of the bid size on the level, imbalance."""
    out = depth.groupBy("symbol", "ts").agg(F.sum("bid_size").alias("bid_depth"), F.sum("ask_size").alias("ask_depth"), F.regr_slope("bid_size", F.col("level").cast("double")).alias("bid_slope"), F.min_by("bid_size", "level").alias("top_bid"), F.min_by("ask_size", "level").alias("top_ask"))
    return out.withColumn("imbalance", fr.div(F.col("bid_depth") - F.col("ask_depth"), F.col("bid_depth") + F.col("ask_depth")))


def vpin(bars: DataFrame, bucket_volume: float) -> DataFrame:
    """Volume-clock buckets by running volume: |volume up - volume down| over the total."""
    up = F.when(F.col("close") >= F.col("open"), F.col("volume")).otherwise(0.0)
    cum = F.sum("volume").over(fr.so_far()) - F.col("volume")
    rows = bars.withColumn("bucket", F.floor(cum / bucket_volume)).withColumn("_up", up)
    out = rows.groupBy("symbol", "bucket").agg(F.sum("_up").alias("_u"), F.sum("volume").alias("volume"), F.min("date").alias("start_date"))
    return out.select("symbol", "bucket", "start_date", fr.div(F.abs(2 * F.col("_u") - F.col("volume")), "volume").alias("vpin"))


def peer_stats(rows: DataFrame, value: str, cluster: str) -> DataFrame:
    """Mean, population dispersion and mean without self of a date's cluster."""
    w = fr.across("date", cluster)
    n, total = F.count(value).over(w), F.sum(value).over(w)
    return rows.select("symbol", "date", cluster, value, F.avg(value).over(w).alias("peer_mean"), F.stddev_pop(value).over(w).alias("peer_dispersion"), F.when((n > 1) & F.col(value).isNotNull(), fr.div(total - F.col(value), n - 1)).alias("peer_ex_self"))


def market(rows: DataFrame, value: str = "ret") -> DataFrame:
    return rows.groupBy("date").agg(F.avg(value).alias("market"), F.count(value).alias("n"))


def weighted_profile(rows: DataFrame, weights: DataFrame, value: str = "ret") -> DataFrame:
    """Weighted return of a date, weights renormalised over the symbols that have a value."""
    met = rows.join(weights, "symbol").where(F.col(value).isNotNull())
    return met.groupBy("date").agg(fr.div(F.sum(F.col("weight") * F.col(value)), F.sum("weight")).alias("profile"), F.count("*").alias("n"))


def daily_sentiment(mentions: DataFrame, mean: int = 3) -> DataFrame:
    out = mentions.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.avg("sentiment").alias("sentiment"), F.sum("volume").alias("volume"))
    return out.withColumn("sentiment_mean", fr.rolling("mean", "sentiment", mean, 1))


def article_features(articles: DataFrame) -> DataFrame:
    """Counts, sizes and shares of the articles of a day; a size stands in for a score."""
    score = fr.clip((F.col("n_chars") - 2000) / 2000.0, -1.0, 1.0)
    rows = articles.withColumn("score", score)
    weight = F.when(F.col("source").rlike("[02468]$"), 2.0).otherwise(1.0)
    return rows.groupBy("symbol", "date").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.max("score").alias("max"), F.min("score").alias("min"), F.avg((F.col("score") > 0.1).cast("double")).alias("positive_share"),
        fr.div(F.sum(weight * F.col("score")), F.sum(weight)).alias("weighted_mean"), F.avg(F.when(F.abs("score") > 0.7, F.col("score"))).alias("confident_mean"),
    )


def insider_sentiment(rows: DataFrame) -> DataFrame:
    buy, sell = F.col("kind") == "buy", F.col("kind") == "sell"
    out = rows.groupBy("symbol").agg(F.count_if(buy).alias("n_buys"), F.count_if(sell).alias("n_sells"), F.sum(F.when(buy, F.col("amount")).otherwise(0.0)).alias("buy_value"), F.sum(F.when(sell, F.col("amount")).otherwise(0.0)).alias("sell_value"))
    return out.withColumn("sentiment", (F.col("buy_value") - F.col("sell_value")) / (F.col("buy_value") + F.col("sell_value") + 1))


def cluster_score(rows: DataFrame, days: int = 14) -> DataFrame:
    """Distinct buyers in the last days before each symbol's latest purchase, log1p(n) log1p(value / 1e5)."""
    buys = rows.where("kind = 'buy'").withColumn("_latest", F.max("date").over(fr.across("symbol"))).where(F.col("date") >= F.date_sub("_latest", days))
    out = buys.groupBy("symbol").agg(F.count_distinct("name").alias("n_insiders"), F.sum("amount").alias("value"))
    return out.withColumn("cluster_score", F.log1p("n_insiders") * F.log1p(F.col("value") / 1e5))


def congress_sentiment(rows: DataFrame) -> DataFrame:
    signed = F.when(F.col("kind") == "buy", 1.0).when(F.col("kind") == "sell", -1.0).otherwise(0.0)
    out = rows.groupBy("symbol").agg(fr.div(F.sum(signed * F.col("amount")), F.sum("amount")).alias("sentiment"), F.count("*").alias("n_trades"))
    return out.withColumn("confidence", F.least(F.col("n_trades") / 5.0, F.lit(1.0)))


def good_traders(rows: DataFrame, least: int = 5, mean: float = 0.05) -> DataFrame:
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.avg("gain").alias("mean_gain")).where((F.col("n") >= least) & (F.col("mean_gain") > mean))


def options_rollup(ticks: DataFrame) -> DataFrame:
    """Put and call volumes by return flag, their ratio, skew of mean tax and discount, and the volume's z over 20 rows."""
    out = ticks.where(F.col("l_returnflag").isin("R", "A")).groupBy("symbol", "date").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("quantity")).otherwise(0.0)).alias("put_volume"), F.sum(F.when(F.col("l_returnflag") == "A", F.col("quantity")).otherwise(0.0)).alias("call_volume"), (F.avg("l_tax") - F.avg("l_discount")).alias("iv_skew")
    )
    out = out.withColumn("pc_ratio", fr.div("put_volume", "call_volume")).withColumn("total_volume", F.col("put_volume") + F.col("call_volume"))
    return out.withColumn("volume_z", fr.zscore("total_volume", 20))


def trailing_rollup(rows: DataFrame, calendar: DataFrame, sums: int = 90, counts: int = 14) -> DataFrame:
    """Disclosed purchases and sales on the calendar's rows: value sentiment over ``sums`` rows, count over ``counts`` rows."""
    signed = F.when(F.col("kind") == "buy", F.col("amount")).when(F.col("kind") == "sell", -F.col("amount")).otherwise(0.0)
    daily = rows.groupBy("symbol", "date").agg(F.sum(signed).alias("net"), F.sum("amount").alias("gross"), F.count("*").alias("n"))
    met = calendar.select("symbol", "date").join(daily, ["symbol", "date"], "left").fillna(0, ["net", "gross", "n"])
    net, gross = fr.rolling("sum", "net", sums, 1), fr.rolling("sum", "gross", sums, 1)
    return met.select("symbol", "date", (net / (gross + 1)).alias("value_sentiment"), fr.rolling("sum", "n", counts, 1).cast("long").alias("recent_count"))


def coverage(panel: DataFrame, domains: dict[str, str]) -> DataFrame:
    """Share of rows with a value, latest date with one and its distance from the latest row, per domain, as rows."""
    latest = F.max("date")
    one = panel.agg(latest.alias("_end"), *(F.avg(F.col(c).isNotNull().cast("double")).alias(f"{d}_share") for d, c in domains.items()), *(F.max(F.when(F.col(c).isNotNull(), F.col("date"))).alias(f"{d}_latest") for d, c in domains.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.col(f"{d}_share").alias("coverage"), F.col(f"{d}_latest").alias("latest"), F.datediff("_end", f"{d}_latest").alias("staleness")) for d in domains)))
    return one.select(rows.alias("x")).select("x.*")


def positions(fills: DataFrame) -> DataFrame:
    """Net quantity, average price, cost and commission of a fills table."""
    signed = F.col("side") * F.col("quantity")
    out = fills.groupBy("symbol").agg(F.sum(signed).alias("net_quantity"), F.sum(signed * F.col("price")).alias("cost"), F.sum("commission").alias("commission"), F.sum("quantity").alias("_q"), F.sum(F.col("quantity") * F.col("price")).alias("_v"))
    return out.withColumn("avg_price", fr.div("_v", "_q")).drop("_q", "_v")


def compound(x: str) -> Column:
    """The return of a group's returns one after another."""
    return F.exp(F.sum(F.log1p(F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(-0.999999))))) - 1


def block_returns(rows: DataFrame, size: int = 126) -> DataFrame:
    """Disjoint blocks of rows that end with the last one: compounded return of the symbol and the market, and who wins."""
    w = fr.series()
    numbered = rows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(fr.across("symbol")))
    blocks = numbered.withColumn("block", F.floor((F.col("_k") - F.col("_n") % size) / size)).where("block >= 0")
    out = blocks.groupBy("symbol", "block").agg(compound("ret").alias("block_return"), compound("market").alias("market_return"))
    return out.withColumn("beats", F.col("block_return") > F.col("market_return"))


def yearly(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.year("date").alias("year")).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.count("ret").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def grid(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.1)).alias("p10"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.9)).alias("p90"), F.avg((F.col(value) > 0).cast("double")).alias("win_probability"))


def trending(rows: DataFrame, least: int, n: int) -> DataFrame:
    out = rows.groupBy("symbol").agg(F.count("*").alias("n_mentions"), F.avg("sentiment").alias("sentiment")).where(F.col("n_mentions") >= least)
    return out.orderBy(F.desc("n_mentions"), "symbol").limit(n)
