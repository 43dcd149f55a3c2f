"""Cross-sectional operators per date: ranks, composites, peer features, fundamentals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr


def momentum_ranks(bars: DataFrame, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Ranks of 5-, 21- and 63-row returns and of the inverse volatility; 0.5 where there is none. ``deal`` may deal rows by date."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_v", fr.rolling("std", "ret", 21)).withColumns({f"_m{n}": fr.change("close", n) for n in (5, 21, 63)})
    out = deal(out.select("symbol", "date", "_v", "_m5", "_m21", "_m63"))
    return out.select("symbol", "date", *(F.coalesce(fr.pct_rank(f"_m{n}"), F.lit(0.5)).alias(f"rank_{n}") for n in (5, 21, 63)), F.coalesce(1 - fr.pct_rank("_v"), F.lit(0.5)).alias("rank_calm"), (F.col("_m21") - F.avg("_m21").over(fr.across("date"))).alias("relative_strength"))


def event_features(bars: DataFrame, surprise: float = 0.3) -> DataFrame:
    """Decay exp(-d / 20) of the last large move's sign, d rows ago, and rolling extremes of its size per symbol."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_e", F.when(F.abs("ret") > surprise, F.signum("ret"))).withColumn("_k", F.row_number().over(fr.series()))
    last = F.last(F.when(F.col("_e").isNotNull(), F.struct("_e", "_k")), True).over(fr.so_far())
    out = out.withColumn("_l", last)
    return out.select("symbol", "date", F.coalesce(F.col("_l._e") * F.exp(-(F.col("_k") - F.col("_l._k")) / 20.0), F.lit(0.0)).alias("pead"), F.coalesce(fr.rolling("sum", F.abs("_e"), 20, 1), F.lit(0.0)).alias("intensity"))


def relative_value(rows: DataFrame, cluster: str) -> DataFrame:
    """Residual against the peers without self, its z over 20 rows, and the basis of the close to the cluster's mean."""
    w = fr.across("date", cluster)
    n, total = F.count("ret").over(w), F.sum("ret").over(w)
    out = rows.withColumn("_peer", F.when((n > 1) & F.col("ret").isNotNull(), fr.div(total - F.col("ret"), n - 1))).withColumn("residual", F.col("ret") - F.col("_peer")).withColumn("basis", fr.div("close", F.avg("close").over(w)) - 1)
    return out.select("symbol", "date", "residual", fr.zscore("residual", 20, 10).alias("residual_z"), "basis")


def execution_costs(bars: DataFrame) -> DataFrame:
    liquidity = fr.safe_pct_rank("_dv")
    out = bars.withColumn("_dv", fr.rolling("mean", F.col("close") * F.col("volume"), 20, 1)).withColumn("liquidity_rank", liquidity)
    spread = fr.div(F.col("high") - F.col("low"), "close")
    return out.select("symbol", "date", "liquidity_rank", F.floor(F.least(F.col("liquidity_rank") * 5, F.lit(4.999))).cast("int").alias("liquidity_bucket"), (spread * (1 - F.col("liquidity_rank"))).alias("spread_cost"), fr.div(F.abs(F.col("volume") - fr.lag("volume")), fr.lag("volume")).alias("turnover_cost"))


def composite(bars: DataFrame) -> DataFrame:
    """Weighted sum of cross-sectional z of momentum, reversal and calm."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_m", fr.change("close", 21)).withColumn("_r", -fr.change("close", 5)).withColumn("_c", -fr.rolling("std", "ret", 21))
    return out.select("symbol", "date", (0.5 * fr.cross_z("_m") + 0.3 * fr.cross_z("_r") + 0.2 * fr.cross_z("_c")).alias("composite"))


def research_panel(rows: DataFrame, cluster: str) -> DataFrame:
    """Market, peer and residual returns over 1, 5 and 20 rows, and whether the row has all of them."""
    w = fr.across("date", cluster)
    out = rows.withColumn("market", F.avg("ret").over(fr.across("date"))).withColumn("peer", F.avg("ret").over(w)).withColumn("residual_1", F.col("ret") - 0.5 * F.col("market") - 0.5 * F.col("peer"))
    return out.select("symbol", "date", "market", "peer", "residual_1", fr.rolling("sum", "residual_1", 5).alias("residual_5"), fr.rolling("sum", "residual_1", 20).alias("residual_20"), (fr.rolling("sum", "residual_1", 20).isNotNull()).alias("complete"))


def state_probabilities(bars: DataFrame) -> DataFrame:
    """Logistic stress and trend probabilities of z scores, their recursive mean and entropy."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_v", fr.rolling("std", "ret", 20)).withColumn("_z", F.coalesce(fr.zscore("_v", 60, 20), F.lit(0.0)))
    out = out.withColumn("stress", fr.sigmoid("_z"))
    out = fr.ema(out, {"stress_smooth": ("stress", 10)})
    p = fr.clip("stress_smooth", 1e-9, 1 - 1e-9)
    return out.select("symbol", "date", "stress", "stress_smooth", (-(p * F.log(p) + (1 - p) * F.log(1 - p))).alias("entropy"))


def graph_features(rows: DataFrame, cluster: str) -> DataFrame:
    """Deviation from the mean of the neighbours, dispersion, and the neighbours' move a row before."""
    w = fr.across("date", cluster)
    n = F.count("ret").over(w)
    out = rows.withColumn("_nb", F.when((n > 1) & F.col("ret").isNotNull(), fr.div(F.sum("ret").over(w) - F.col("ret"), n - 1)))
    return out.select("symbol", "date", (F.col("ret") - F.col("_nb")).alias("laplacian"), F.stddev_pop("ret").over(w).alias("dispersion"), fr.lag("_nb").alias("shock"))


def uncertainty(bars: DataFrame, n: int = 20) -> DataFrame:
    """Width of twice the 90 % quantile of past absolute errors of a mean forecast, and how often the last move missed it."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_f", fr.lag(fr.rolling("mean", "ret", n))).withColumn("_err", F.abs(F.col("ret") - F.col("_f")))
    past = fr.series().rowsBetween(-n, -1)
    out = out.withColumn("width", F.when(F.count("_err").over(past) >= n, 2 * F.percentile("_err", F.lit(0.9)).over(past)))
    out = out.withColumn("_miss", F.when(F.col("width").isNotNull() & F.col("_err").isNotNull(), (2 * F.col("_err") > F.col("width")).cast("double")))
    return out.select("symbol", "date", "width", fr.rolling("mean", "_miss", n, 5).alias("miss_rate"), F.percentile("width", F.lit(0.5)).over(fr.so_far()).alias("usual_width"))


def top_bottom(rows: DataFrame, score: str, n: int) -> DataFrame:
    """+1 for the n largest scores of a date, -1 for the n smallest, ties by symbol; one sort in each direction."""
    high, low = Window.partitionBy("date").orderBy(F.desc(score), "symbol"), Window.partitionBy("date").orderBy(F.asc(score), "symbol")
    known = rows.where(F.col(score).isNotNull())
    out = known.withColumn("_h", F.row_number().over(high)).withColumn("_l", F.row_number().over(low))
    return out.withColumn("signal", F.when(F.col("_h") <= n, 1).when(F.col("_l") <= n, -1).otherwise(0)).drop("_h", "_l")


def adaptive_momentum(bars: DataFrame) -> DataFrame:
    """Return over 5, 10 or 21 rows, the longer the calmer the market, and its rank."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("_mk", F.avg("ret").over(fr.across("date"))).withColumn("_v", fr.rolling("std", "_mk", 20))
    m = F.when(F.col("_v") > 0.5, fr.change("close", 5)).when(F.col("_v") > 0.2, fr.change("close", 10)).otherwise(fr.change("close", 21))
    return out.withColumn("momentum", m).select("symbol", "date", "momentum", fr.pct_rank("momentum").alias("momentum_rank"))


def ratios(f: DataFrame) -> DataFrame:
    return f.select("symbol", fr.div("price", fr.div("ebit", "shares")).alias("pe"), fr.div(F.col("price") * F.col("shares"), "revenue").alias("ps"), fr.div("debt", "ebit").alias("debt_to_ebit"), fr.div("ebit", "revenue").alias("margin"), fr.div("cash", "liabilities").alias("cash_ratio"))


def percentile_composite(rows: DataFrame, directions: dict[str, int], name: str) -> DataFrame:
    """Mean of percentile ranks over all symbols, each in its direction; nulls rank at the bottom and count."""
    ranks = []
    for c, sign in directions.items():
        x = F.col(c) * sign
        order = Window.orderBy(x.asc_nulls_first())  # a dimension of one row per symbol
        ties = F.count(F.lit(1)).over(Window.partitionBy(F.coalesce(x, F.lit(float("-inf")))))
        ranks.append((F.rank().over(order) + (ties - 1) / 2) / F.count(F.lit(1)).over(Window.partitionBy()))
    return rows.withColumn(name, sum(ranks[1:], ranks[0]) / len(ranks))


def altman(f: DataFrame) -> DataFrame:
    """Z from working capital, retained earnings, operating profit, equity and sales over assets, and its zone."""
    assets = F.col("liabilities") + F.abs("cash") + F.col("ebit")
    z = 1.2 * fr.div("cash", assets) + 1.4 * fr.div(F.col("ebit") * 0.5, assets) + 3.3 * fr.div("ebit", assets) + 0.6 * fr.div(F.col("price") * F.col("shares"), "liabilities") + 1.0 * fr.div("revenue", assets)
    return f.withColumn("z", z).select("symbol", "z", F.when(F.col("z") > 2.99, "safe").when(F.col("z") < 1.81, "distress").otherwise("grey").alias("zone"))


def piotroski(f: DataFrame) -> DataFrame:
    """Points of a snapshot: profit, cash, profit over cash, low debt, liquidity, margin; two further tests always pass."""
    tests = [F.col("ebit") > 0, F.col("cash") > 0, F.col("cash") > F.col("ebit"), F.col("debt") < F.col("revenue") * 0.05, F.col("cash") > F.col("liabilities") * 0.01, fr.div("ebit", "revenue") > 0.04, F.col("shares") > 0]
    return f.select("symbol", (sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) + 2).cast("int").alias("f_score"))


def growth(bars: DataFrame) -> DataFrame:
    """Yearly sums of volume: growth, acceleration, compound rate since the first year, stability 1 / (1 + cv)."""
    years = bars.groupBy("symbol", F.year("date").alias("year")).agg(F.sum("volume").alias("sales"))
    w = fr.series("symbol", "year")
    out = years.withColumn("growth", fr.change("sales", order="year")).withColumn("acceleration", F.col("growth") - F.lag("growth").over(w))
    first = F.first("sales").over(fr.so_far("symbol", "year"))
    k = F.row_number().over(w) - 1
    every = fr.across("symbol")
    return out.withColumn("cagr", F.when(k > 0, F.pow(fr.div("sales", first), 1.0 / k) - 1)).withColumn("stability", 1 / (1 + fr.div(F.stddev_samp("sales").over(every), F.avg("sales").over(every))))


def fair_value(f: DataFrame, growth_rate: float = 0.04, discount: float = 0.1, years: int = 5, terminal: float = 0.02) -> DataFrame:
    """Discounted operating profit per share as a geometric series, with a terminal value; and the capped upside."""
    q = (1 + growth_rate) / (1 + discount)
    series = q * (1 - q**years) / (1 - q)
    end = q**years * (1 + terminal) / (discount - terminal)
    value = fr.div("ebit", "shares") * (series + end)
    return f.withColumn("fair_value", value).select("symbol", "fair_value", F.least(fr.div("fair_value", "price") - 1, F.lit(1.0)).alias("upside"))


def squeeze(rows: DataFrame) -> DataFrame:
    """Weighted ratios of returned to total quantity and their rise, and the share of rises in the last 5 rows."""
    out = rows.withColumn("ratio", fr.div("put_volume", F.col("put_volume") + F.col("call_volume"))).withColumn("_up", F.when(fr.lag("ratio").isNotNull(), (F.col("ratio") > fr.lag("ratio")).cast("double")))
    return out.select("symbol", "date", (0.6 * F.coalesce("ratio", F.lit(0.0)) + 0.4 * F.coalesce(F.col("ratio") - fr.lag("ratio", 3), F.lit(0.0))).alias("squeeze"), (F.coalesce(fr.rolling("mean", "_up", 5), F.lit(0.0)) > 0.6).alias("building"))
