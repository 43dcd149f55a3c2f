"""Row frames, ranks, recursive averages and guarded arithmetic, with one meaning each.

Frames count rows, never time. A rolling value is null until enough non-null rows are in its frame. Division by zero is
null. Ranks give tied rows their mean rank. Every window of a given key and order is the same object, so that one sort
serves all columns over it.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@cache
def series(key: str = "symbol", order: str = "date") -> WindowSpec:
    """The rows of a key in order."""
    return Window.partitionBy(key).orderBy(order)


@cache
def last_rows(n: int, key: str = "symbol", order: str = "date") -> WindowSpec:
    """The current row and the n - 1 before it."""
    return series(key, order).rowsBetween(1 - n, 0)


@cache
def so_far(key: str = "symbol", order: str = "date") -> WindowSpec:
    return series(key, order).rowsBetween(Window.unboundedPreceding, 0)


@cache
def across(*keys: str) -> WindowSpec:
    """All rows of a date, or of other keys."""
    return Window.partitionBy(*(keys or ("date",)))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(kind: str, x, n: int, least: int | None = None, key: str = "symbol", order: str = "date") -> Column:
    """mean, std (sample), pstd, var, sum, min, max or median over the last n rows; null below ``least`` values (default n)."""
    how = {"mean": F.avg, "std": F.stddev_samp, "pstd": F.stddev_pop, "var": F.var_samp, "sum": F.sum, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5))}[kind]
    w = last_rows(n, key, order)
    return F.when(F.count(_c(x)).over(w) >= (n if least is None else least), how(_c(x)).over(w))


def lag(x, n: int = 1, key: str = "symbol", order: str = "date") -> Column:
    return F.lag(_c(x), n).over(series(key, order))


def lead(x, n: int = 1, key: str = "symbol", order: str = "date") -> Column:
    return F.lead(_c(x), n).over(series(key, order))


def div(a, b) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def change(x, n: int = 1, key: str = "symbol", order: str = "date") -> Column:
    """x relative to its value n rows ago, less 1."""
    return div(x, lag(x, n, key, order)) - 1


def clip(x, low: float, high: float) -> Column:
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(low)), F.lit(high)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def norm_cdf(x) -> Column:
    """The normal distribution function by a rational approximation of erfc; its error is below 1.2e-7."""
    z = F.abs(_c(x)) / F.lit(math.sqrt(2.0))
    t = 1 / (1 + 0.5 * z)
    # Coefficients of the approximation.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    tail = t * F.exp(-z * z + poly) / 2
    return F.when(_c(x) >= 0, 1 - tail).otherwise(tail)


def zscore(x, n: int, least: int | None = None) -> Column:
    """(x - rolling mean) / rolling sample deviation; null where the deviation is 0."""
    return div(_c(x) - rolling("mean", x, n, least), rolling("std", x, n, least))


def stepped_std(x, n: int, least: int | None = None) -> Column:
    """``rolling("std")`` for short frames, a value at a time from the oldest on: the product of a value's distances from the means after
    and before it is added, as the SQL's engine does, so that what lies exactly at a threshold falls on the same side."""
    values = F.collect_list(_c(x)).over(last_rows(n))

    def step(state: Column, v: Column) -> Column:
        count = state["n"] + 1
        mean = state["mean"] + (v - state["mean"]) / count
        return F.struct(count.alias("n"), mean.alias("mean"), (state["square"] + (v - mean) * (v - state["mean"])).alias("square"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))
    found = F.aggregate(values, start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["square"] / (s["n"] - 1))))
    return F.when(F.size(values) >= (n if least is None else least), found)


def corrected_skew(x, w: WindowSpec) -> Column:
    """Bias-corrected skewness; null below 3 values or without spread."""
    n = F.count(_c(x)).over(w).cast("double")
    return F.when((n > 2) & (F.stddev_pop(_c(x)).over(w) > 0), F.skewness(_c(x)).over(w) * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(x, w: WindowSpec) -> Column:
    """Bias-corrected excess kurtosis; null below 4 values or without spread."""
    n = F.count(_c(x)).over(w).cast("double")
    return F.when((n > 3) & (F.stddev_pop(_c(x)).over(w) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(_c(x)).over(w) + 6))


def correlation(x, y, w: WindowSpec) -> Column:
    """Correlation over pairs of non-null values; null without spread (the built-in function fails there)."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    a, b = F.when(both, _c(x)), F.when(both, _c(y))
    return div(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w))


def pct_rank(x, *keys: str) -> Column:
    """Mean rank of ties over the number of non-null values of the date; null for null."""
    x = _c(x)
    keys = keys or ("date",)
    order = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())  # one sort for both
    below = F.rank().over(order).cast("double")
    ties = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (below + (ties - 1) / 2) / F.count(x).over(across(*keys)))


def safe_pct_rank(x, *keys: str) -> Column:
    """As ``pct_rank``, but 0.5 where the date has at most one distinct value."""
    w = across(*(keys or ("date",)))
    return F.when(F.min(_c(x)).over(w).eqNullSafe(F.max(_c(x)).over(w)), 0.5).otherwise(pct_rank(x, *keys))


def cross_z(x, *keys: str) -> Column:
    """z over the date with the population deviation, nulls as 0; 0 where there is no spread."""
    w, x = across(*(keys or ("date",))), F.coalesce(_c(x), F.lit(0.0))
    return F.when(F.stddev_pop(x).over(w) <= 1e-12, 0.0).otherwise((x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0)))


def running(df: DataFrame, products: dict[str, Column], key: str = "symbol", order: str = "date") -> DataFrame:
    """Add {name: sum of the non-null products of all rows so far}."""
    w = so_far(key, order)
    return df.withColumns({name: F.coalesce(F.sum(x).over(w), F.lit(0.0)) for name, x in products.items()})


def block_sums(df: DataFrame, products: dict[str, Column], n: int, key: str = "symbol", order: str = "date") -> DataFrame:
    """Add {name: sum of the non-null products of the last n rows}: of the row's block of n rows so far, and of the rows of the
    block before that are still in the frame. Nothing is subtracted, so no earlier value costs precision."""
    out = df.withColumn("_place", F.row_number().over(series(key, order)) - 1).withColumn("_block", F.floor(F.col("_place") / n))
    up = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key, "_block").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    out = out.withColumns({f"_r{name}": F.coalesce(F.sum(x).over(down), zero) for name, x in products.items()})
    out = out.withColumns({f"_o{name}": F.coalesce(F.sum(x).over(up), zero) for name, x in products.items()})
    old = {name: F.when(F.col("_place") % n == n - 1, zero).otherwise(F.coalesce(F.lag(f"_r{name}", n - 1).over(series(key, order)), zero)) for name in products}
    return out.withColumns({name: F.col(f"_o{name}") + old[name] for name in products}).drop("_place", "_block", *(f"{a}{name}" for a in ("_r", "_o") for name in products))


def moments(df: DataFrame, x: str, wanted: dict[str, tuple[str, int, int]], key: str = "symbol", order: str = "date") -> DataFrame:
    """Add {name: (kind, n, least)}: mean, sum, std, skew or kurt (as ``corrected_skew`` and ``corrected_kurtosis``) of x over
    the last n rows, null below ``least`` values.

    Differences of running sums of powers of x less the key's first value (no later row counts), so that a row costs the same for any n; for
    skew and kurt, whose powers would keep the error of every outlier so far, sums of blocks. A window whose squares about
    its mean are below 1e-12 of those that its sums were taken from counts as one without spread.
    """
    w = series(key, order)
    top = max({"mean": 1, "sum": 1, "std": 2, "skew": 3, "kurt": 4}[kind] for kind, _, _ in wanted.values())
    out = df.withColumn("_centre", F.first(x, True).over(so_far(key, order))).withColumn("_d", F.col(x) - F.col("_centre"))
    powers = [F.when(F.col("_d").isNotNull(), F.lit(1.0)), F.col("_d"), F.col("_d") * F.col("_d"), F.col("_d") * F.col("_d") * F.col("_d"), F.col("_d") * F.col("_d") * F.col("_d") * F.col("_d")]
    sizes = sorted({n for _, n, _ in wanted.values()})
    if top > 2:
        for n in sizes:
            out = block_sums(out, {f"_p{k}_{n}": powers[k] for k in range(top + 1)}, n, key, order)
        out = out.withColumns({f"_p{k}": F.col(f"_p{k}_{sizes[-1]}") for k in range(top + 1)})
    else:
        out = running(out, {f"_p{k}": powers[k] for k in range(top + 1)}, key, order)
        out = out.withColumns({f"_p{k}_{n}": F.col(f"_p{k}") - F.coalesce(F.lag(f"_p{k}", n).over(w), F.lit(0.0)) for k in range(top + 1) for n in sizes})
    found = {}
    for name, (kind, n, least) in wanted.items():
        m, *p = (F.col(f"_p{k}_{n}") for k in range(top + 1))
        mean = div(p[0], m)
        if kind in ("mean", "sum"):
            value = (F.col("_centre") + mean) * (m if kind == "sum" else 1)
        else:
            square = p[1] - p[0] * mean
            square = F.when(square > 1e-12 * F.col("_p2"), square).otherwise(0.0)
            var = div(square, m)
            if kind == "std":
                value = F.sqrt(div(square, m - 1))
            elif kind == "skew":
                third = div(p[2], m) - 3 * mean * div(p[1], m) + 2 * mean * mean * mean
                value = F.when((m > 2) & (var > 0), div(third, F.pow(var, F.lit(1.5))) * F.sqrt(m * (m - 1)) / (m - 2))
            else:
                fourth = div(p[3], m) - 4 * mean * div(p[2], m) + 6 * mean * mean * div(p[1], m) - 3 * mean * mean * mean * mean
                value = F.when((m > 3) & (var > 0), (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * (div(fourth, var * var) - 3) + 6))
        found[name] = F.when(m >= least, value)
    return out.withColumns(found).drop("_centre", "_d", *(f"_p{k}" for k in range(top + 1)), *(f"_p{k}_{n}" for k in range(top + 1) for n in sizes))


def rolling_correlation(df: DataFrame, name: str, x: str, y: str, n: int, key: str = "symbol", order: str = "date") -> DataFrame:
    """Add the correlation of x and y over the pairs of non-null values of the last n rows, from running sums; null without spread."""
    w = series(key, order)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    first = lambda c: F.first(F.when(both, F.col(c)), True).over(so_far(key, order))
    out = df.withColumns({"_x": F.when(both, F.col(x) - first(x)), "_y": F.when(both, F.col(y) - first(y))})
    parts = {"_n": F.when(both, F.lit(1.0)), "_sx": F.col("_x"), "_sy": F.col("_y"), "_sxx": F.col("_x") * F.col("_x"), "_syy": F.col("_y") * F.col("_y"), "_sxy": F.col("_x") * F.col("_y")}
    out = running(out, parts, key, order)
    m, sx, sy, sxx, syy, sxy = (F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0.0)) for c in parts)
    out = out.withColumns({"_m": m, "_a": sx, "_b": sy, "_aa": sxx, "_bb": syy, "_ab": sxy})
    a, b = F.col("_aa") - div(F.col("_a") * F.col("_a"), "_m"), F.col("_bb") - div(F.col("_b") * F.col("_b"), "_m")
    spread = F.when((a > 1e-12 * F.col("_sxx")) & (b > 1e-12 * F.col("_syy")), F.sqrt(a * b))
    return out.withColumn(name, div(F.col("_ab") - div(F.col("_a") * F.col("_b"), "_m"), spread)).drop("_x", "_y", *parts, "_m", "_a", "_b", "_aa", "_bb", "_ab")


def rolling_max(df: DataFrame, name: str, x: str, n: int, key: str = "symbol", order: str = "date") -> DataFrame:
    """Add the largest non-null x of the last n rows: of the row's block of n rows so far, and of the end of the block before."""
    out = df.withColumn("_block", F.floor((F.row_number().over(series(key, order)) - 1) / n))
    up = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key, "_block").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_rest", F.max(x).over(down)).withColumn("_own", F.max(x).over(up))
    return out.withColumn(name, F.greatest("_own", F.lag("_rest", n - 1).over(series(key, order)))).drop("_block", "_rest", "_own")


def ema(df: DataFrame, columns: dict[str, tuple[str, float]], key: str = "symbol", order: str = "date", by: str | None = None) -> DataFrame:
    """Add recursive averages: {new name: (column, span)}; y0 = x0, y = (1 - a) y' + a x with a = 2 / (span + 1).

    The first non-null value starts the average; it is null before, and a null value leaves it as it was. Closed form over
    chunks of rows short enough that the weights stay finite: the chunk's own discounted sum, plus the discounted state
    at the end of the chunk before. States two chunks back weigh less than 1e-13. No Python, two sorts.

    ``by`` names a column that is null where all of ``columns`` are, and only there: then all averages share their chunks, and two
    sorts serve them all.
    """
    return ema_alpha(df, {k: (c, 2.0 / (span + 1)) for k, (c, span) in columns.items()}, key, order, by)


#: Largest exponent of e in the weights of one chunk.
_STEEP = 600.0


def ema_alpha(df: DataFrame, columns: dict[str, tuple[str, float]], key: str = "symbol", order: str = "date", by: str | None = None) -> DataFrame:
    sizes = {a: max(1, int(30 / -math.log(1 - a))) if 0 < a < 1 else 1 for _, a in columns.values()}
    groups: list[dict[str, tuple[str, float]]] = []
    for name, (column, alpha) in sorted(columns.items(), key=lambda x: -sizes[x[1][1]]):
        # the longest chunks first; an average joins them if its weights stay finite over their rows
        if by and groups and 0 < alpha < 1 and -math.log(1 - alpha) * max(sizes[a] for _, a in groups[-1].values()) < _STEEP:
            groups[-1][name] = (column, alpha)
        else:
            groups.append({name: (column, alpha)})
    for group in groups:
        df = _averages(df, group, max(sizes[a] for _, a in group.values()), by or next(iter(group.values()))[0], key, order)
    return df


def _averages(df: DataFrame, columns: dict[str, tuple[str, float]], size: int, by: str, key: str, order: str) -> DataFrame:
    """Averages of columns that are null where ``by`` is, over chunks of ``size`` of its values."""
    w = series(key, order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_rn", F.count(by).over(upto) - 1).withColumn("_chunk", F.floor(F.col("_rn") / size))  # of the non-null values
    place, there = F.pmod(F.col("_rn"), F.lit(size)).cast("double"), F.col(by).isNotNull()
    chunk = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    full = there & (place == size - 1)
    d = {name: 1 - alpha for name, (_, alpha) in columns.items()}
    start = {name: F.when(F.col("_rn") == 0, F.col(column)).otherwise(F.col(column) * alpha) for name, (column, alpha) in columns.items()}
    out = out.withColumns({f"_own_{n}": F.pow(F.lit(d[n]), place) * F.sum(start[n] * F.pow(F.lit(d[n]), -place)).over(chunk) for n in columns})
    out = out.withColumns({f"_end_{n}": F.when(full, F.col(f"_own_{n}")) for n in columns})
    past = lambda n: F.coalesce(F.last(f"_end_{n}", True).over(before), F.lit(0.0))
    out = out.withColumns({f"_end_{n}": F.when(full, F.col(f"_own_{n}") + d[n] ** size * past(n)) for n in columns})
    out = out.withColumns({f"_y_{n}": F.when(there, F.col(f"_own_{n}") + F.pow(F.lit(d[n]), place + 1) * past(n)) for n in columns})
    out = out.withColumns({n: F.last(f"_y_{n}", True).over(upto) for n in columns})
    return out.drop("_rn", "_chunk", *(f"{p}{n}" for n in columns for p in ("_own_", "_end_", "_y_")))


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp without time zone; no session setting counts."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), _c(ts))


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """The keys, and all other columns with doubles rounded: the form in which results are compared.

    As the SQL rounds: the product with the power of ten goes to the nearest whole number, halves away from zero. ``round`` alone looks at
    the decimal digits, and so differs where a share ends with a 5 after its last digit (41 / 640). Prices over quantities end after
    7 decimals, often with a 5; 8 digits keep them whole.
    """
    kinds, scale = dict(df.dtypes), 10.0**digits

    def nearest(c: str) -> Column:
        out = F.round(F.col(c) * scale) / scale
        return F.when(F.abs(out) < math.inf, out).otherwise(F.col(c)).alias(c)

    return df.select(*keys, *(nearest(c) if kinds[c] == "double" else F.col(c) for c in df.columns if c not in keys))
