"""Event look-ups, text panels, sleeves, risk states and reports over stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr


def event_context(events: DataFrame, at: str) -> DataFrame:
    """Per symbol the last event before the day and the first from it on, with the days between."""
    day = F.lit(at).cast("date")
    out = events.groupBy("symbol").agg(F.max(F.when(F.col("date") < day, F.struct("date", "amount"))).alias("_p"), F.min(F.when(F.col("date") >= day, F.struct("date", "amount"))).alias("_n"))
    return out.select("symbol", F.col("_p.date").alias("previous_date"), F.col("_p.amount").alias("previous_amount"), F.col("_n.date").alias("next_date"), F.col("_n.amount").alias("next_amount"), F.datediff(day, F.col("_p.date")).alias("days_since"), F.datediff(F.col("_n.date"), day).alias("days_to"))


def upcoming(events: DataFrame, at: str, days: int) -> DataFrame:
    """Per symbol how many events lie within the days from ``at`` on, and the first."""
    day = F.lit(at).cast("date")
    inside = (F.col("date") >= day) & (F.col("date") <= F.date_add(day, days))
    return events.groupBy("symbol").agg(F.count_if(inside).alias("n_upcoming"), F.min(F.when(inside, F.col("date"))).alias("first_upcoming"), F.max(inside).alias("in_window"))


def surprises(quarters: DataFrame, n: int = 4) -> DataFrame:
    """(symbol, date, value) -> per symbol the latest surprise against the mean of the n quarters before, the share of beats over
    2 %, predictability 1 / (1 + deviation), and a rating."""
    w = fr.series().rowsBetween(-n, -1)
    out = quarters.withColumn("_e", F.when(F.count("value").over(w) >= n, F.avg("value").over(w))).withColumn("surprise", fr.div(F.col("value") - F.col("_e"), F.abs("_e")))
    known = out.where("surprise is not null").groupBy("symbol").agg(F.max_by("surprise", "date").alias("latest"), F.avg((F.col("surprise") > 0.02).cast("double")).alias("beat_rate"), (1 / (1 + F.coalesce(F.stddev_samp("surprise"), F.lit(0.0)))).alias("predictability"), F.count("*").alias("n"))
    return known.withColumn("signal", F.when(F.col("latest") > 0.05, 1).when(F.col("latest") < -0.05, -1).otherwise(0))


def short_gate(signals: DataFrame, regimes: DataFrame, members: DataFrame, weak: list[str]) -> DataFrame:
    """Short signals of the listed symbols become 0 unless the date's regime is weak."""
    met = signals.join(F.broadcast(regimes), "date", "left").join(members.select("symbol", F.lit(True).alias("_in")), "symbol", "left")
    shut = F.col("_in").isNotNull() & (F.col("signal") < 0) & ~F.coalesce(F.col("regime").isin(weak), F.lit(False))
    return met.select("symbol", "date", F.when(shut, 0).otherwise(F.col("signal")).alias("signal"))


def ticker_sentiment(posts: DataFrame) -> DataFrame:
    """(tickers, sentiment, engagement) -> per ticker mentions, sentiment weighted by log engagement, mention rank and z.

    Ranks and z are over one row a ticker: a small table by its nature, gathered after the aggregate.
    """
    each = posts.withColumn("ticker", F.explode("tickers")).withColumn("_w", F.log1p("engagement"))
    out = each.groupBy("ticker").agg(F.count("*").alias("mentions"), fr.div(F.sum(F.col("sentiment") * F.col("_w")), F.sum("_w")).alias("sentiment"))
    stats = out.agg(F.avg("mentions").alias("_m"), F.stddev_pop("mentions").alias("_s"))
    return out.join(F.broadcast(stats)).withColumn("mention_z", fr.div(F.col("mentions") - F.col("_m"), "_s")).drop("_m", "_s")


def tone(rows: DataFrame) -> DataFrame:
    """Means of 5 and 20 rows, z over 60 where the deviation exceeds 0.01, momentum, reversal, volatility and acceleration of a daily tone."""
    out = rows.withColumns({"ma_5": fr.rolling("mean", "tone", 5, 1), "ma_20": fr.rolling("mean", "tone", 20, 5), "_m": fr.rolling("mean", "tone", 60, 20), "_s": fr.rolling("std", "tone", 60, 20), "volatility": fr.rolling("std", "tone", 20, 5)})
    out = out.withColumn("z", F.when(F.col("_s") > 0.01, (F.col("tone") - F.col("_m")) / F.col("_s"))).withColumn("momentum", F.col("ma_5") - F.col("ma_20")).withColumn("reversal", F.when(F.abs("z") > 2, -F.signum("z")).otherwise(0.0))
    return out.withColumn("acceleration", F.col("momentum") - fr.lag("momentum")).select("symbol", "date", "ma_5", "ma_20", "z", "momentum", "reversal", "volatility", "acceleration")


def implied_sentiment(bars: DataFrame) -> DataFrame:
    """What prices imply: z of the gap, surprises of range and volume, fear and greed, divergence, gap fill."""
    out = bars.withColumn("ret", fr.change("close")).withColumn("gap", fr.div("open", fr.lag("close")) - 1).withColumn("range", fr.div(F.col("high") - F.col("low"), "close"))
    out = out.withColumns({"gap_z": fr.zscore("gap", 20, 10), "range_surprise": fr.div("range", fr.rolling("mean", "range", 20, 10)) - 1, "volume_surprise": fr.div("volume", fr.rolling("mean", "volume", 20, 10)) - 1, "place": fr.div(F.col("close") - F.col("low"), F.col("high") - F.col("low"))})
    out = out.withColumns({"fear_greed": F.tanh(3 * fr.rolling("mean", "ret", 10, 5)) * F.coalesce("place", F.lit(0.5)), "divergence": F.signum("ret") * F.signum("volume_surprise"), "gap_filled": F.when(F.col("gap").isNotNull(), ((F.col("gap") > 0) & (F.col("low") <= fr.lag("close")) | (F.col("gap") < 0) & (F.col("high") >= fr.lag("close"))).cast("int"))})
    return out.select("symbol", "date", "ret", "gap_z", "range_surprise", "volume_surprise", "fear_greed", "divergence", "gap_filled")


def training_rows(features: DataFrame, names: list[str], horizon: int = 5) -> DataFrame:
    """Features of the row before, and the compounded return of the next rows with its sign; incomplete rows are dropped."""
    growth = F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(fr.series().rowsBetween(1, horizon))) - 1
    out = features.withColumns({f"{c}_before": fr.lag(c) for c in names}).withColumn("target", F.when(fr.lead("ret", horizon).isNotNull(), growth))
    kept = [f"{c}_before" for c in names]
    return out.select("symbol", "date", *kept, "target", (F.col("target") > 0).cast("int").alias("label")).dropna()


def sleeves(rows: DataFrame, n: int = 63, low: float = 0.05, high: float = 0.6) -> DataFrame:
    """(sleeve, date, ret) -> per date the blended return at inverse volatilities of the n rows before, bounded, scaled to one."""
    w = Window.partitionBy("sleeve").orderBy("date").rowsBetween(-n, -1)
    inverse = F.when(F.count("ret").over(w) >= n, fr.div(F.lit(1.0), F.stddev_samp("ret").over(w)))
    out = rows.withColumn("_i", inverse).where("_i is not null").withColumn("_w", fr.clip(F.col("_i") / F.sum("_i").over(fr.across("date")), low, high))
    return out.groupBy("date").agg(fr.div(F.sum(F.col("_w") * F.col("ret")), F.sum("_w")).alias("ret"), F.count("*").alias("n"))


def relative_edge(rows: DataFrame, n: int = 63) -> DataFrame:
    """Trailing excess return over the market, tracking error and information ratio on each symbol's last row."""
    out = rows.withColumn("_x", F.col("ret") - F.col("market")).withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("_k") <= n)
    out = out.groupBy("symbol").agg(F.count("_x").alias("n"), F.sum("_x").alias("excess"), (F.stddev_pop("_x") * F.sqrt(F.lit(252.0))).alias("tracking_error"), (F.avg("_x") * 252).alias("_m"))
    return out.select("symbol", "n", "excess", "tracking_error", fr.div("_m", "tracking_error").alias("information_ratio"))


def veto(rows: DataFrame, columns: tuple[str, str], overall: float, daily: float) -> DataFrame:
    """An edge of 0.6 and 0.4 of two scores; vetoed below its quantile over all rows or over its date."""
    edge = rows.withColumn("edge", 0.6 * F.col(columns[0]) + 0.4 * F.col(columns[1])).where("edge is not null")
    floor = edge.agg(F.percentile("edge", F.lit(overall)).alias("_all"))
    days = edge.groupBy("date").agg(F.percentile("edge", F.lit(daily)).alias("_day"))
    met = edge.join(F.broadcast(floor)).join(days, "date")
    return met.select("symbol", "date", "edge", ((F.col("edge") < F.col("_all")) | (F.col("edge") < F.col("_day"))).alias("vetoed"))


def slot_long_short(rows: DataFrame, score: str, value: str, k: int, cost: float) -> DataFrame:
    """Per slot the mean of the k best less that of the k worst, less the cost of both sides."""
    known = rows.where(F.col(score).isNotNull() & F.col(value).isNotNull())
    ranked = known.withColumn("_h", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc(score), "symbol"))).withColumn("_l", F.row_number().over(Window.partitionBy("slot").orderBy(F.asc(score), "symbol"))).withColumn("_n", F.count("*").over(Window.partitionBy("slot"))).where(F.col("_n") >= 2 * k)
    out = ranked.groupBy("slot").agg(F.avg(F.when(F.col("_h") <= k, F.col(value))).alias("_a"), F.avg(F.when(F.col("_l") <= k, F.col(value))).alias("_b"))
    return out.select("slot", (F.col("_a") - F.col("_b") - 2 * cost).alias("ret"))


def prediction_check(rows: DataFrame, score: str, value: str) -> DataFrame:
    """Per date the share of right signs and the return weighted by the prediction's distance from a half."""
    known = rows.where(F.col(score).isNotNull() & F.col(value).isNotNull()).withColumn("_e", F.col(score) - 0.5)
    return known.groupBy("date").agg(F.count("*").alias("n"), F.avg((F.signum("_e") == F.signum(value)).cast("double")).alias("hit_rate"), fr.div(F.sum(F.col("_e") * F.col(value)), F.sum(F.abs("_e"))).alias("weighted_return"))


def fills(rows: DataFrame) -> DataFrame:
    """(order, quantity, amount, wanted) -> average fill price, fill rate and a reason where an order is not whole."""
    out = rows.groupBy("order").agg(F.count("*").alias("n_fills"), F.sum("quantity").alias("filled"), F.max("wanted").alias("wanted"), fr.div(F.sum("amount"), F.sum("quantity")).alias("average_price"))
    out = out.withColumn("fill_rate", fr.div("filled", "wanted"))
    return out.withColumn("reason", F.when(F.col("filled") <= 0, "empty").when(F.col("fill_rate") < 1, "partial").when(F.col("fill_rate") > 1, "overfilled").otherwise("filled"))


def stress_windows(rows: DataFrame, windows: list[tuple[str, str, str]], worst: float) -> DataFrame:
    """Return, deviation and largest fall of a daily series in named windows, and whether the fall stays within ``worst``."""
    spark = rows.sparkSession
    table = spark.createDataFrame(windows, "name string, first string, last string").select("name", F.to_date("first").alias("first"), F.to_date("last").alias("last"))
    met = rows.join(F.broadcast(table), (F.col("date") >= F.col("first")) & (F.col("date") <= F.col("last")))
    w = Window.partitionBy("name").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = met.withColumn("_g", F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(w)).withColumn("_f", F.col("_g") - F.greatest(F.max("_g").over(w), F.lit(0.0)))
    out = grown.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).alias("growth"), F.stddev_samp("ret").alias("deviation"), (F.exp(F.min("_f")) - 1).alias("largest_fall"))
    return out.withColumn("passes", F.col("largest_fall") >= worst)


def correlation_regime(pairs: DataFrame, by: str) -> DataFrame:
    """Mean absolute correlation of a group's pairs, its regime, and how many pairs raise an alert."""
    out = pairs.groupBy(by).agg(F.count("correlation").alias("n"), F.avg("correlation").alias("mean_correlation"), F.count_if(F.abs("correlation") > 0.2).alias("alerts"))
    return out.withColumn("regime", F.when(F.col("mean_correlation") > 0.05, "high").when(F.col("mean_correlation") < 0, "low").otherwise("normal"))


def histogram(rows: DataFrame, by: str, x: str, bins: int) -> DataFrame:
    """Equal-width densities of x between a key's extremes; the largest value is in the last bin, a key of one value in the first."""
    ends = rows.where(F.col(x).isNotNull()).groupBy(by).agg(F.min(x).alias("_a"), F.max(x).alias("_b"), F.count("*").alias("_n"))
    place = F.coalesce(F.least(F.floor(fr.div(F.col(x) - F.col("_a"), F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)), F.lit(0))
    met = rows.where(F.col(x).isNotNull()).join(ends, by).withColumn("bin", place.cast("int"))
    return met.groupBy(by, "bin").agg(F.count("*").alias("n"), F.max(fr.div(F.lit(1.0), F.col("_n") * (F.col("_b") - F.col("_a")) / bins)).alias("_u")).select(by, "bin", "n", (F.col("n") * F.col("_u")).alias("density"))


def quality_points(rows: DataFrame) -> DataFrame:
    """Points for margin, debt, coverage and cash; and a value score for a low price against revenue per share."""
    margin, debt, cover = fr.div("ebit", "revenue"), fr.div("debt", "revenue"), fr.div("ebit", "debt")
    points = F.when(margin > 0.045, 3).when(margin > 0.04, 2).when(margin > 0.03, 1).otherwise(0) + F.when(debt < 0.045, 2).when(debt < 0.055, 1).otherwise(0) + F.when(cover > 1, 2).when(cover > 0.8, 1).otherwise(0) + F.when(F.col("cash") > 5000, 2).when(F.col("cash") > 0, 1).otherwise(0)
    worth = fr.div(fr.div("revenue", "shares"), "price")
    return rows.select("symbol", margin.alias("margin"), debt.alias("debt_share"), cover.alias("coverage"), fr.div(F.col("debt") - F.col("cash"), "ebit").alias("net_debt_to_ebit"), fr.div("ebit", F.col("liabilities") + F.col("cash")).alias("return_on_capital"), points.alias("quality_points"), F.when(worth > 0.04, 2).when(worth > 0.02, 1).otherwise(0).alias("value_points"))


def session_profit(curve: DataFrame, x: str = "close") -> DataFrame:
    """Profit since the first row, return in percent, and the change against the row before."""
    first = F.first(x).over(fr.so_far())
    return curve.select("symbol", "date", (F.col(x) - first).alias("profit"), (100 * (fr.div(F.col(x), first) - 1)).alias("return_percent"), (F.col(x) - fr.lag(x)).alias("change"))


def candidate_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(symbol, segment, excess) -> the weighted excess over segments, and the worst of them."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.max(F.when(F.col("segment") == name, F.col("excess"))), F.lit(0.0))
    return rows.groupBy("symbol").agg(total.alias("score"), F.min("excess").alias("worst"))
