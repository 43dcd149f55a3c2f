"""Queries of state clusters, macro columns and filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import rounded
from ..operators import regimes as g
from ..sources import market as m
from .registry import query, sql
from .technical import W, r, roll

KEYS = ("symbol", "date")
COLUMNS = ["volatility", "momentum_20", "momentum_60", "drawdown"]


def states(spark, sf_dir):
    return g.mixture(g.features(m.daily_bars(spark, sf_dir)).select(*KEYS, "ret", *COLUMNS), COLUMNS)


@query("G16_state_clusters")
def state_clusters(spark, sf_dir):
    return rounded(g.moves(states(spark, sf_dir), 4), "before", "after", "n")


@query("G35_regime_labels")
def regime_labels(spark, sf_dir):
    """Each symbol's regime on each date: the state of its features, by the name that the state's next returns give it."""
    rows = states(spark, sf_dir)
    return rows.join(F.broadcast(g.labelled(rows).select("state", "regime")), "state").select(*KEYS, "state", "regime")


FEATURES = f"""ft AS (SELECT symbol, date, {roll('stddev_samp', 'ret', 20)} AS volatility, close / nullif(lag(close, 20) OVER w, 0) - 1 AS momentum_20, close / nullif(lag(close, 60) OVER w, 0) - 1 AS momentum_60,
close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), 0) - 1 AS drawdown FROM rets {W})"""


@query("G35_macro_features", sql("rets", f""", {FEATURES}, rl AS (SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) + INTERVAL 1 MONTH AS DATE) AS date, avg(o_totalprice) AS level FROM orders GROUP BY 1), rc AS (SELECT *, level / nullif(lag(level) OVER (ORDER BY date), 0) - 1 AS change FROM rl)
SELECT ft.symbol, ft.date, {r(volatility='volatility', momentum_20='momentum_20', momentum_60='momentum_60', drawdown='drawdown', macro_level='level', macro_change='change')}, CAST(ft.date - rc.date AS INTEGER) AS macro_age FROM ft ASOF LEFT JOIN rc ON ft.date >= rc.date"""))
def macro_features(spark, sf_dir):
    """Monthly means of orders, known from the month after on, beside the features of bars."""
    orders = m.table(spark, sf_dir, "orders")
    releases = orders.groupBy(F.add_months(F.trunc(F.to_date("o_orderdate"), "month"), 1).alias("date")).agg(F.avg("o_totalprice").alias("level"))
    rows = g.with_macro(g.features(m.daily_bars(spark, sf_dir)).select(*KEYS, *COLUMNS), releases)
    return rounded(rows, *KEYS, "macro_age")


def reports(spark, sf_dir):
    """Ownership reports as XML documents from orders and their lines; every 50th is cut off in the middle."""
    lines = m.table(spark, sf_dir, "lineitem")
    code = F.when(F.col("l_returnflag") == "R", "P").when(F.col("l_returnflag") == "A", "A").otherwise("S")
    amount = lambda name, c: F.concat(F.lit(f"<{name}><value>"), F.col(c).cast("string"), F.lit(f"</value></{name}>"))
    one = F.concat(F.lit("<nonDerivativeTransaction><transactionCoding><transactionCode>"), code, F.lit("</transactionCode></transactionCoding><transactionAmounts>"), amount("transactionShares", "l_quantity"), amount("transactionPricePerShare", "l_extendedprice"), F.lit("</transactionAmounts></nonDerivativeTransaction>"))
    many = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("filed"), F.concat_ws("", F.collect_list(one)).alias("_t"))
    xml = F.concat(F.lit("<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>owner "), (F.col("id") % 97).cast("string"), F.lit(" &amp; sons</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable>"), "_t", F.lit("</nonDerivativeTable></ownershipDocument>"))
    return many.withColumn("_x", xml).select("id", F.to_date("filed").alias("filed"), F.when(F.col("id") % 50 == 0, F.expr("substring(_x, 1, length(_x) div 2)")).otherwise(F.col("_x")).alias("xml"))


@query("S19_filings", f"""WITH d AS (SELECT l_orderkey AS id, CAST(min(l_shipdate) OVER (PARTITION BY l_orderkey) AS DATE) AS filed, l_returnflag, l_quantity, l_extendedprice FROM lineitem)
SELECT id, filed, true AS malformed, NULL AS owner, NULL AS kind, NULL AS shares, NULL AS price, NULL AS value FROM d WHERE id % 50 = 0 GROUP BY id, filed UNION ALL
SELECT id, filed, false, 'owner ' || CAST(id % 97 AS VARCHAR) || ' & sons', CASE WHEN l_returnflag IN ('R', 'A') THEN 'buy' ELSE 'sell' END, round(CAST(l_quantity AS DOUBLE), 6), round(CAST(l_extendedprice AS DOUBLE), 6), round(CAST(l_quantity * l_extendedprice AS DOUBLE), 6) FROM d WHERE id % 50 <> 0""")
def filings(spark, sf_dir):
    return rounded(g.filings(reports(spark, sf_dir)), "id", "filed", "malformed", "owner", "kind")
