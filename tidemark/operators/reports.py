"""Gates, comparisons and rule tables over metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr


def gate(metrics: DataFrame, key: str, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """Each metric against its rule (higher, lower or abs_lower than a limit): passes, checks, verdict."""
    long = metrics.select(key, *rules).unpivot([key], list(rules), "metric", "value")
    passed: Column = F.lit(None).cast("boolean")
    for name, (how, limit) in rules.items():
        x = F.abs("value") if how == "abs_lower" else F.col("value")
        passed = F.when(F.col("metric") == name, (x >= limit) if how == "higher" else (x <= limit)).otherwise(passed)
    judged = long.where("value is not null").withColumn("_p", passed)
    out = judged.groupBy(key).agg(F.count_if("_p").alias("passes"), F.count("*").alias("checks"))
    return out.withColumn("verdict", F.when(F.col("passes") == F.col("checks"), "pass").when(F.col("passes") * 2 >= F.col("checks"), "watch").otherwise("fail"))


def fail_reasons(metrics: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The names of the rules that do not hold, in order."""
    return metrics.select(key, F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))), ",").alias("reasons"))


def calendar(returns: DataFrame) -> DataFrame:
    """date, its place ``_d`` in the calendar, and the number of dates ``_n``."""
    dates = returns.select("date").distinct()
    return dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("_d"), F.count("*").over(Window.partitionBy()).alias("_n"))


def window_starts(returns: DataFrame, windows: int, size: int, seed: int) -> DataFrame:
    """start: ``windows`` different places over the whole calendar that leave room for a window, drawn by a seeded hash; all where there are fewer."""
    drawn = calendar(returns).where((F.col("_n") > size) & (F.col("_d") + size <= F.col("_n")))
    return drawn.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "_d"))).limit(windows).select(F.col("_d").alias("start"))


def random_windows(returns: DataFrame, starts: list[int] | DataFrame, size: int) -> DataFrame:
    """Mean return of every symbol in whole windows of rows of the calendar, and the winner of each window."""
    dates = calendar(returns)
    dealt = dates.join(F.broadcast(starts)) if isinstance(starts, DataFrame) else dates.withColumn("start", F.explode(F.array(*map(F.lit, starts))))
    end = F.col("start") + size
    placed = dealt.where((F.col("_d") >= F.col("start")) & (F.col("_d") < end) & (end <= F.col("_n"))).select("date", "start")
    means = returns.where("ret is not null").join(F.broadcast(placed), "date").groupBy("start", "symbol").agg(F.avg("ret").alias("mean"))
    return means.groupBy("start").agg(F.max_by("symbol", F.struct("mean", -F.col("symbol"))).alias("winner"), F.max("mean").alias("best"), F.count("*").alias("n"))


def alerts(metrics: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(metric, limit, level) rules against melted metrics; the rules are a small table."""
    names = [c for c in metrics.columns if c != key]
    long = metrics.unpivot([key], names, "metric", "value")
    return long.join(F.broadcast(rules), "metric").where(F.col("value") > F.col("limit")).select(key, "metric", "value", "level")


def provider_choice(candidates: DataFrame) -> DataFrame:
    """The provider of the best weighted score of freshness, completeness, latency and reliability for each key; scores that agree
    to nine digits are ties and go to the first name."""
    score = F.round(0.3 * F.col("freshness") + 0.3 * F.col("completeness") + 0.2 * (1 - F.least(F.col("latency_ms") / 1000.0, F.lit(1.0))) + 0.2 * F.col("reliability"), 9)
    ranked = candidates.withColumn("score", score).withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "provider")))
    return ranked.where("_k = 1").select("key", "provider", "score")


def median_parameters(rows: DataFrame, names: list[str]) -> DataFrame:
    long = rows.select(*(F.col(n).cast("double").alias(n) for n in names)).unpivot([], names, "parameter", "value")
    return long.groupBy("parameter").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_samp("value").alias("std"))


def signal_returns(rows: DataFrame, cost: float) -> DataFrame:
    """tanh(prediction) times the next return, less cost for the change of the signal."""
    out = rows.withColumn("signal", F.tanh("prediction")).withColumn("_b", F.coalesce(fr.lag("signal"), F.lit(0.0)))
    return out.where("forward_return is not null").select("symbol", "date", (F.col("signal") * F.col("forward_return") - cost * F.abs(F.col("signal") - F.col("_b"))).alias("net"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    met = a.select(key, *(F.col(c).alias(f"_{c}") for c in metrics)).join(b.select(key, *metrics), key)
    return met.select(key, *((F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in metrics))


def store_quality(present: DataFrame, symbols: DataFrame, dates: DataFrame, domains: list[str]) -> DataFrame:
    """Completeness of each domain over the grid of its symbols and dates, from counts; the grid is never built."""
    grid = symbols.agg(F.count_distinct("symbol").alias("_s")).join(F.broadcast(dates.agg(F.count_distinct("date").alias("_d"))))
    found = present.where(F.col("domain").isin(domains)).groupBy("domain").agg(F.count_distinct("symbol", "date").alias("present"))
    return found.join(F.broadcast(grid)).select("domain", "present", fr.div("present", F.col("_s") * F.col("_d")).alias("completeness"))
