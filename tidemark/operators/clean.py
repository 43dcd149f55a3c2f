"""Cleaning, imputation, quality checks and selection of panel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr

PRICES = ("open", "high", "low", "close")


def keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def null_invalid(bars: DataFrame) -> DataFrame:
    """Prices of 0 or less and volumes below 0 are null."""
    out = bars.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in PRICES})
    return out.withColumn("volume", F.when(F.col("volume") >= 0, F.col("volume")))


def robust_clip(rows: DataFrame, columns: tuple[str, ...] = PRICES, width: float = 6.0, key: str = "symbol") -> DataFrame:
    """Clip to the median +- width * 1.4826 * median absolute deviation of the key, where that is over 0."""
    medians = rows.groupBy(key).agg(*(F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in columns))
    met = rows.join(medians, key)
    spreads = met.groupBy(key).agg(*(F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), F.lit(0.5)).alias(f"_d_{c}") for c in columns))
    met = met.join(spreads, key)
    band = {c: width * 1.4826 * F.col(f"_d_{c}") for c in columns}
    out = met.withColumns({c: F.when((F.col(f"_d_{c}") > 0) & F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_m_{c}") - band[c]), F.col(f"_m_{c}") + band[c])).otherwise(F.col(c)) for c in columns})
    return out.drop(*(f"_{k}_{c}" for k in "md" for c in columns))


def winsorize(rows: DataFrame, column: str, low: float = 0.001, high: float = 0.999, key: str = "symbol") -> DataFrame:
    """Clip to two quantiles of the key (linear interpolation)."""
    bounds = rows.groupBy(key).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_q"))
    met = rows.join(bounds, key)
    return met.withColumn(column, F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("_q")[0]), F.col("_q")[1]))).drop("_q")


def enforce_ohlc(bars: DataFrame) -> DataFrame:
    """high and low enclose open and close."""
    return bars.withColumn("high", F.greatest("high", "open", "close")).withColumn("low", F.least("low", "open", "close"))


def fill(rows: DataFrame, columns: tuple[str, ...], limit: int = 5) -> DataFrame:
    """The last value of at most ``limit`` rows ago, else the next of at most ``limit`` rows ahead."""
    back, ahead = fr.series().rowsBetween(-limit, 0), fr.series().rowsBetween(0, limit)
    out = rows.withColumns({c: F.last(c, True).over(back) for c in columns})
    return out.withColumns({c: F.first(c, True).over(ahead) for c in columns})


def fill_volume(rows: DataFrame, n: int = 20) -> DataFrame:
    """A null volume becomes the median of the last n rows, else 0."""
    return rows.withColumn("volume", F.coalesce("volume", F.percentile("volume", F.lit(0.5)).over(fr.last_rows(n)), F.lit(0.0)))


def standardise(rows: DataFrame, columns: tuple[str, ...], limit: float = 5.0) -> DataFrame:
    """z over all rows, clipped; a deviation of 0 counts as 1. The statistics are one row and are broadcast."""
    stats = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    met = rows.join(F.broadcast(stats))
    out = met.withColumns({c: fr.clip((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0), -limit, limit) for c in columns})
    return out.drop(*(f"_{k}_{c}" for k in "ms" for c in columns))


def scale(rows: DataFrame, column: str, how: str) -> DataFrame:
    """minmax: to 0..1 over all rows; robust: distance from the median over the interquartile range. A range of 0 counts as 1."""
    if how == "minmax":
        stats = rows.agg(F.min(column).alias("_a"), (F.max(column) - F.min(column)).alias("_b"))
    else:
        q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        stats = rows.agg(q.alias("_q")).select(F.col("_q")[1].alias("_a"), (F.col("_q")[2] - F.col("_q")[0]).alias("_b"))
    met = rows.join(F.broadcast(stats))
    return met.withColumn(f"{column}_{how}", (F.col(column) - F.col("_a")) / F.when(F.col("_b") > 0, F.col("_b")).otherwise(1.0)).drop("_a", "_b")


def validate(bars: DataFrame, jump: float = 0.5) -> DataFrame:
    """Counts of each kind of fault per symbol, and the names of those found."""
    rows = bars.withColumn("_ret", fr.change("close"))
    missing = sum((F.col(c).isNull().cast("double") for c in (*PRICES, "volume")), F.lit(0.0))
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), F.avg(missing / 5).alias("missing_ratio"), F.count_if(F.least(*PRICES) <= 0).alias("bad_price"), F.count_if(F.col("high") < F.col("low")).alias("crossed"),
        F.count_if(F.col("volume") < 0).alias("bad_volume"), F.count_if(F.abs("_ret") > jump).alias("jumps"), (F.count("*") - F.count_distinct("date")).alias("repeated"),
    )
    faults = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in ("missing_ratio", "bad_price", "crossed", "bad_volume", "jumps", "repeated"))))
    return out.withColumn("issues", F.array_join(faults, ","))


def deduplicate_titles(articles: DataFrame, length: int = 80) -> DataFrame:
    """The first article of each normalised title: lower case, no punctuation, single blanks, cut to ``length``."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9 ]", ""), " +", " "))
    return keep_last(articles.withColumn("title_key", F.substring(title, 1, length)), ["title_key"], F.col("id").asc())


def recent(rows: DataFrame, date_column: str, days: int, amount: float) -> DataFrame:
    """Rows of the last ``days`` before the latest date, of ``amount`` at least. The latest date is one row and is broadcast."""
    latest = rows.agg(F.max(date_column).alias("_latest"))
    return rows.join(F.broadcast(latest)).where((F.col(date_column) >= F.date_sub("_latest", days)) & (F.col("amount") >= amount)).drop("_latest")


def most_liquid(bars: DataFrame, n: int = 20, rows: int = 20, history: int = 30) -> DataFrame:
    """The n symbols of the largest mean dollar volume over their last rows, among those with enough history."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    out = bars.withColumn("_nth", F.row_number().over(back)).withColumn("_n", F.count("*").over(fr.across("symbol"))).where((F.col("_nth") <= rows) & (F.col("_n") >= history))
    return out.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("dollar_volume")).orderBy(F.desc("dollar_volume"), "symbol").limit(n)


def daily_mean(rows: DataFrame, ts: str, value: str) -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("date")).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def lag_signals(rows: DataFrame, columns: dict[str, float], n: int = 1) -> DataFrame:
    """Each column n rows later, with its own fill for the rows before."""
    return rows.withColumns({c: F.coalesce(fr.lag(c, n), F.lit(v)) for c, v in columns.items()})


def align(sparse: DataFrame, calendar: DataFrame, column: str, limit: int) -> DataFrame:
    """Sparse values on the calendar's dates, carried forward over at most ``limit`` rows."""
    met = calendar.join(sparse.select("symbol", "date", column), ["symbol", "date"], "left")
    return met.withColumn(column, F.last(column, True).over(fr.series().rowsBetween(-limit, 0)))


def split_by_date(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """is_train: dates up to the quantile of the distinct dates, by their number."""
    dates = rows.select("date").distinct()
    ranked = dates.withColumn("_k", F.row_number().over(Window.orderBy("date"))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return rows.join(F.broadcast(ranked), "date").withColumn("is_train", F.col("_k") <= F.floor(F.col("_n") * share)).drop("_k", "_n")
