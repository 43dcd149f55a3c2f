"""Panel tables derived from the stored tables: bars, trades, quotes, depth, mentions, articles, disclosures, fundamentals.

Each adapter only projects, filters and aggregates, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem with a price: symbol, date, price, quantity and its place within the day."""
    rows = table(spark, sf_dir, "lineitem")
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return rows.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), fr.div("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("quantity"), place.alias("place"), "l_returnflag", "l_discount", "l_tax").where("price is not null")


#: Rows of a symbol-wise partition: a task of the widest feature build keeps some 2 KB a row in its sorts.
DEALT = 200_000


def dealt(rows: DataFrame, spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """The rows by ``key``, over partitions whose number grows with the table of ticks, so that what a task sorts does not."""
    n = table(spark, sf_dir, "lineitem").count()  # of footers
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-n // DEALT)), key)


def by_date(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Deals rows of bars by date, for ranks of a date."""
    return lambda rows: dealt(rows, spark, sf_dir, "date")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume: ticks are dealt by symbol once, which also serves all windows by symbol."""
    return dealt(ticks(spark, sf_dir).select("symbol", "date", "price", "quantity", "place"), spark, sf_dir, "symbol").groupBy("symbol", "date").agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "place").alias("close"), F.sum("quantity").alias("volume")
    )


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", fr.change("close"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select(F.col("user_id").alias("symbol"), "ts", "event_id", (F.col("value") + 1).alias("price"), k.alias("volume"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").where("event_type = 'view'")
    half = 0.05 * (1 + k / 100)
    mid = F.col("value") + 1
    return rows.select(F.col("user_id").alias("symbol"), "ts", "event_id", (mid - half).alias("bid"), (mid + half).alias("ask"), (F.col("event_id") % 7 + 1).cast("double").alias("bid_size"), (F.col("event_id") % 5 + 1).cast("double").alias("ask_size"))


def depth(spark: SparkSession, sf_dir: str, levels: int = 10) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("symbol"), "ts", k.alias("k"), "event_id")
    out = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    return out.select("symbol", "ts", "level", ((levels + 1 - F.col("level")) * (1 + F.col("k"))).alias("bid_size"), ((levels + 1 - F.col("level")) * (1 + F.col("event_id") % 3)).cast("double").alias("ask_size"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").where("event_type = 'click'")
    return rows.select(F.col("user_id").alias("symbol"), "ts", "event_id", fr.clip((F.col("value") - 50) / 50, -1.0, 1.0).alias("sentiment"), k.alias("volume"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") % 2499).cast("int"))
    return rows.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("symbol"), day.alias("date"), F.col("text").alias("title"), "source", "n_chars")


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose title is the whole text."""
    day = F.date_add(F.lit("1995-01-02").cast("date"), (F.col("doc_id") % 2499).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), day.alias("date"), F.col("text").alias("title"), "source")


def disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    kind = F.when(F.col("o_orderpriority").rlike("^[12]"), "buy").when(F.col("o_orderpriority").rlike("^[45]"), "sell").otherwise("other")
    return rows.select((F.col("o_custkey") % 100).alias("symbol"), F.col("o_custkey").alias("name"), day.alias("date"), F.date_add(day, 30).alias("disclosed"), kind.alias("kind"), F.col("o_totalprice").alias("amount"), "o_orderkey")


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector (region), industry (nation): fixed clusters."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("symbol"), F.col("n_regionkey").alias("sector"), F.col("s_nationkey").alias("industry"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per symbol; sums of prices, discounts, taxes and the balance stand in for statement items."""
    rows = table(spark, sf_dir, "lineitem")
    sums = rows.groupBy(F.col("l_suppkey").alias("symbol")).agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("debt"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("ebit"),
        F.sum("l_quantity").alias("shares"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("liabilities"), F.avg("l_extendedprice").alias("price"),
    )
    return sums.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("cash")), "symbol")
