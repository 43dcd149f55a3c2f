"""Portfolios from ranked rows, their performance, and statistical validation, each for many portfolios at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import frames as fr


def compound(x: str = "ret") -> Column:
    return F.exp(F.sum(F.log1p(F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(-0.999999))))) - 1


def top_k(rows: DataFrame, score: str, k: int, value: str) -> DataFrame:
    """Mean of ``value`` over the k best scores of each date (ties by symbol): the window limit stops at k rows a date."""
    w = Window.partitionBy("date").orderBy(F.desc(score), "symbol")
    best = rows.where(F.col(score).isNotNull() & F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
    return best.groupBy("date").agg(F.avg(value).alias("ret"), F.count("*").alias("n"))


def performance(returns: DataFrame, by: str, periods: int = 252) -> DataFrame:
    """Return, growth rate, volatility, Sharpe, Sortino, drawdown, Calmar, tail means, win rate, payoff, profit factor."""
    curve = returns.withColumn("growth", F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))))
    curve = curve.withColumn("_dd", F.col("growth") / F.greatest(F.max("growth").over(Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)) - 1)
    up, down = F.col("ret") > 0, F.col("ret") < 0
    stats = curve.groupBy(by).agg(
        F.count("*").alias("n"), compound().alias("total_return"), F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"), F.sqrt(F.avg(F.when(down, F.col("ret") * F.col("ret")).otherwise(0.0))).alias("_down"),
        F.min("_dd").alias("max_drawdown"), F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))).alias("ulcer"), F.percentile("ret", F.lit(0.05)).alias("var_5"), F.avg(up.cast("double")).alias("win_rate"),
        fr.div(F.avg(F.when(up, F.col("ret"))), -F.avg(F.when(down, F.col("ret")))).alias("payoff"), fr.div(F.sum(F.when(up, F.col("ret")).otherwise(0.0)), -F.sum(F.when(down, F.col("ret")).otherwise(0.0))).alias("profit_factor"),
    )
    tail = curve.join(stats.select(by, "var_5"), by).where("ret <= var_5").groupBy(by).agg(F.avg("ret").alias("cvar_5"))
    out = stats.join(tail, by, "left").withColumn("cagr", F.pow(1 + F.col("total_return"), F.lit(float(periods)) / F.col("n")) - 1)
    root = math.sqrt(periods)
    out = out.withColumn("calmar", fr.div("cagr", F.abs("max_drawdown")))
    return out.select(by, "n", "total_return", "cagr", "calmar", (F.col("_sd") * root).alias("volatility"), (fr.div("_mean", "_sd") * root).alias("sharpe"), (fr.div("_mean", "_down") * root).alias("sortino"), "max_drawdown", "ulcer", "var_5", "cvar_5", "win_rate", "payoff", "profit_factor")


def streaks(returns: DataFrame, by: str) -> DataFrame:
    """Longest runs of gains, of losses and of rows below the highest growth so far, and total return over the deepest fall."""
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("_g", F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(w)))
    out = out.withColumn("_dd", F.col("_g") / F.greatest(F.max("_g").over(w), F.lit(1.0)) - 1)
    kinds = {"wins": F.col("ret") > 0, "losses": F.col("ret") < 0, "under_water": F.col("_dd") < 0}
    out = out.withColumns({f"_{k}": c for k, c in kinds.items()})
    # a run's rows share the number of rows outside so far, so its length is its place behind the last of them
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("date")))
    out = out.withColumns({f"_o_{k}": F.coalesce(F.max(F.when(~F.col(f"_{k}"), F.col("_n"))).over(w), F.lit(0)) for k in kinds})
    longest = {k: F.max(F.when(F.col(f"_{k}"), F.col("_n") - F.col(f"_o_{k}")).otherwise(0)) for k in kinds}
    return out.groupBy(by).agg(*(c.alias(k) for k, c in longest.items()), fr.div(F.max_by("_g", "date") - 1, F.abs(F.min("_dd"))).alias("recovery"))


def relative(rows: DataFrame, by: str) -> DataFrame:
    """Beta, alpha, tracking error, information ratio and capture of ``ret`` against ``market``."""
    both = rows.where(F.col("ret").isNotNull() & F.col("market").isNotNull()).withColumn("_x", F.col("ret") - F.col("market"))
    up, down = F.col("market") > 0, F.col("market") < 0
    out = both.groupBy(by).agg(F.count("*").alias("n"), fr.div(F.covar_samp("ret", "market"), F.var_pop("market")).alias("beta"), F.avg("ret").alias("_r"), F.avg("market").alias("_m"), F.avg("_x").alias("_a"), F.stddev_samp("_x").alias("tracking_error"),
                              fr.div(F.avg(F.when(up, F.col("ret"))), F.avg(F.when(up, F.col("market")))).alias("up_capture"), fr.div(F.avg(F.when(down, F.col("ret"))), F.avg(F.when(down, F.col("market")))).alias("down_capture"))
    return out.select(by, "n", "beta", (F.col("_r") - F.col("beta") * F.col("_m")).alias("alpha"), "tracking_error", fr.div("_a", "tracking_error").alias("information_ratio"), "up_capture", "down_capture")


def value_at_risk(rows: DataFrame, by: str) -> DataFrame:
    """Historical, normal and Cornish-Fisher value at risk at 95 %, and the mean beyond the historical one."""
    z = -1.6448536269514722
    stats = rows.where("ret is not null").groupBy(by).agg(F.count("*").alias("n"), F.percentile("ret", F.lit(0.05)).alias("_q"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.stddev_pop("ret").alias("_p"), F.avg(F.pow("ret", F.lit(3))).alias("_m3"), F.avg(F.pow("ret", F.lit(4))).alias("_m4"), F.avg(F.pow("ret", F.lit(2))).alias("_m2"))
    m = F.col("_m")
    third = F.col("_m3") - 3 * m * F.col("_m2") + 2 * m * m * m
    fourth = F.col("_m4") - 4 * m * F.col("_m3") + 6 * m * m * F.col("_m2") - 3 * m * m * m * m
    out = stats.withColumn("_sk", fr.div(third, F.pow("_p", F.lit(3)))).withColumn("_ku", fr.div(fourth, F.pow("_p", F.lit(4))) - 3)
    adjusted = z + (z * z - 1) * F.col("_sk") / 6 + (z**3 - 3 * z) * F.col("_ku") / 24 - (2 * z**3 - 5 * z) * F.col("_sk") * F.col("_sk") / 36
    out = out.withColumn("var_cornish_fisher", -(m + adjusted * F.col("_s")))
    tail = rows.join(out.select(by, "_q"), by).where("ret <= _q").groupBy(by).agg((-F.avg("ret")).alias("cvar"))
    return out.join(tail, by).select(by, "n", (-F.col("_q")).alias("var_historical"), (-(m + z * F.col("_s"))).alias("var_normal"), "var_cornish_fisher", "cvar")


def kelly(rows: DataFrame, by: str) -> DataFrame:
    up, down = F.col("ret") > 0, F.col("ret") < 0
    out = rows.where("ret is not null and ret <> 0").groupBy(by).agg(F.avg(up.cast("double")).alias("win_rate"), fr.div(F.avg(F.when(up, F.col("ret"))), -F.avg(F.when(down, F.col("ret")))).alias("payoff"))
    return out.withColumn("kelly", F.when(F.col("payoff") > 0, fr.clip(F.col("win_rate") - (1 - F.col("win_rate")) / F.col("payoff"), 0.0, 1.0)))


def stepped_long_short(rows: DataFrame, score: str, value: str, step: int, k: int) -> DataFrame:
    """Every ``step``-th date: mean of the k best less mean of the k worst."""
    dates = rows.select("date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("_d") % step == 0)
    known = rows.where(F.col(score).isNotNull() & F.col(value).isNotNull()).join(F.broadcast(dates.select("date")), "date")
    ranked = known.withColumn("_h", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "symbol"))).withColumn("_l", F.row_number().over(Window.partitionBy("date").orderBy(F.asc(score), "symbol")))
    return ranked.groupBy("date").agg(F.avg(F.when(F.col("_h") <= k, F.col(value))).alias("long_return"), F.avg(F.when(F.col("_l") <= k, F.col(value))).alias("short_return")).withColumn("spread", F.col("long_return") - F.col("short_return"))


def turnover(books: DataFrame) -> DataFrame:
    """Share of the names of consecutive books of (date, symbol) that changed: a full outer join on the book's number."""
    dates = books.select("date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("date")))
    now = books.join(F.broadcast(dates), "date").select("_d", "symbol", F.lit(1).alias("_now"))
    before = now.select((F.col("_d") + 1).alias("_d"), "symbol", F.lit(1).alias("_before"))
    both = now.join(before, ["_d", "symbol"], "full")
    out = both.groupBy("_d").agg(F.count_if(F.col("_now").isNull() | F.col("_before").isNull()).alias("changed"), F.count("*").alias("names"))
    return out.join(F.broadcast(dates), "_d").select("date", "changed", "names")


def capped_book(rows: DataFrame, score: str, cluster: str, per_cluster: int) -> DataFrame:
    """Weights of a long-short book: at most ``per_cluster`` names of a cluster on each side, equal within a side."""
    known = rows.where(F.col(score).isNotNull())
    high = Window.partitionBy("date", cluster).orderBy(F.desc(score), "symbol")
    low = Window.partitionBy("date", cluster).orderBy(F.asc(score), "symbol")
    sided = known.withColumn("_h", F.row_number().over(high)).withColumn("_l", F.row_number().over(low)).withColumn("_n", F.count("*").over(Window.partitionBy("date", cluster)))
    sided = sided.where(F.col("_n") >= 2 * per_cluster).withColumn("side", F.when(F.col("_h") <= per_cluster, 1).when(F.col("_l") <= per_cluster, -1)).where("side is not null")
    return sided.withColumn("weight", F.col("side") * 0.5 / F.count("*").over(Window.partitionBy("date", "side")))


def beat_ratio(rows: DataFrame, n: int = 63) -> DataFrame:
    """Share of rolling sums over n rows in which ``ret`` beats ``market``."""
    out = rows.withColumn("_a", fr.rolling("sum", "ret", n)).withColumn("_b", fr.rolling("sum", "market", n)).where("_a is not null and _b is not null")
    return out.groupBy("symbol").agg(F.avg((F.col("_a") > F.col("_b")).cast("double")).alias("beat_ratio"), F.count("*").alias("n"))


def information_coefficient(rows: DataFrame, factors: list[str], target: str) -> DataFrame:
    """Rank correlation of each factor with the target on each date, from mean ranks of ties."""
    long = rows.select("symbol", "date", target, *factors).unpivot(["symbol", "date", target], factors, "factor", "value").where(F.col("value").isNotNull() & F.col(target).isNotNull())
    ranked = long.select("date", "factor", fr.pct_rank("value", "date", "factor").alias("_x"), fr.pct_rank(target, "date", "factor").alias("_y"))
    return ranked.groupBy("factor", "date").agg(F.count("*").alias("n"), fr.div(F.covar_samp("_x", "_y"), F.stddev_samp("_x") * F.stddev_samp("_y")).alias("ic"))


def permutation_test(returns: DataFrame, by: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Sign flips by a hash of seed, replicate and date: share of replicates with a mean at least as large.

    Replicates multiply the rows inside the map task; the partial aggregate leaves one row for each task and replicate.
    """
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "replicate", by, "date"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    flips = returns.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).groupBy(by, "replicate").agg(F.avg(sign * F.col("ret")).alias("_m"))
    real = returns.groupBy(by).agg(F.avg("ret").alias("mean"))
    return flips.join(real, by).groupBy(by).agg(F.first("mean").alias("mean"), ((1 + F.count_if(F.col("_m") >= F.col("mean"))) / (F.count("*") + 1)).alias("p_value"))


def bootstrap(returns: DataFrame, by: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean; each replicate draws every row by a Poisson(1) count of a hashed uniform."""
    u = F.pmod(F.xxhash64(F.lit(seed), "replicate", by, "date"), F.lit(1_000_000)) / 1e6
    cuts = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(6)]
    times = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    draws = returns.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_t", times).groupBy(by, "replicate").agg(fr.div(F.sum(F.col("_t") * F.col("ret")), F.sum("_t")).alias("_m"))
    return draws.groupBy(by).agg(F.percentile("_m", F.lit(0.05)).alias("low"), F.percentile("_m", F.lit(0.95)).alias("high"))


def walk_forward_folds(rows: DataFrame, train: int, test: int) -> DataFrame:
    """fold, part and row counts of rolling folds over date ordinals; a date may be in several folds."""
    dates = rows.select("date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("date")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    fold = F.explode(F.sequence(F.greatest(F.floor((F.col("_d") - train - test) / test) + 1, F.lit(0)), F.floor(F.col("_d") / test)))
    placed = dates.withColumn("fold", fold).withColumn("_k", F.col("_d") - F.col("fold") * test).where((F.col("_k") >= 0) & (F.col("_k") < train + test) & (F.col("fold") * test + train + test <= F.col("_n")))
    parts = placed.select("date", "fold", F.when(F.col("_k") < train, "train").otherwise("test").alias("part"))
    return rows.join(F.broadcast(parts), "date").groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def sweep(rows: DataFrame, score: str, value: str, ks: tuple[int, ...], thresholds: tuple[float, ...]) -> DataFrame:
    """Mean and deviation of the top-k portfolio for every k and score threshold, in one job over one ranking."""
    w = Window.partitionBy("date").orderBy(F.desc(score), "symbol")
    ranked = rows.where(F.col(score).isNotNull() & F.col(value).isNotNull()).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(ks))
    grid = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("_k <= k").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.col(score) >= F.col("threshold"))
    daily = grid.groupBy("k", "threshold", "date").agg(F.avg(value).alias("ret"))
    return daily.groupBy("k", "threshold").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"))


def inverse_variance(bars: DataFrame, n: int = 20) -> DataFrame:
    out = bars.withColumn("ret", fr.change("close")).withColumn("_v", fr.rolling("var", "ret", n)).withColumn("_i", F.when(F.col("_v") > 0, 1 / F.col("_v")))
    return out.where("_i is not null").select("symbol", "date", fr.div("_i", F.sum("_i").over(fr.across("date"))).alias("weight"))


def limit_breaches(book: DataFrame, cluster: str, single: float, group: float) -> DataFrame:
    """Positions and clusters whose share of the gross exposure is over a limit."""
    gross = F.sum(F.abs("exposure")).over(Window.partitionBy())
    shares = book.withColumn("share", fr.div(F.abs("exposure"), gross))
    own = shares.where(F.col("share") > single).select(F.lit("position").alias("kind"), F.col("symbol").cast("long").alias("key"), "share")
    groups = shares.groupBy(F.col(cluster).cast("long").alias("key")).agg(F.sum("share").alias("share")).where(F.col("share") > group).select(F.lit("cluster").alias("kind"), "key", "share")
    return own.unionByName(groups)


def stress(book: DataFrame, shocks: DataFrame, cluster: str) -> DataFrame:
    """Loss of a book in each scenario, by the cluster's shock; scenarios are a small table."""
    met = book.join(F.broadcast(shocks), cluster)
    return met.groupBy("scenario").agg(F.sum(F.col("exposure") * F.col("shock")).alias("loss"), F.min(F.col("exposure") * F.col("shock")).alias("worst"), F.count("*").alias("n"))
