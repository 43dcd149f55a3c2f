"""As-of, interval and calendar joins, as unions with windows or equi-joins: one shuffle by the key, no pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, on: str, columns: list[str], key: str = "symbol", forward: bool = False, tolerance: Column | None = None) -> DataFrame:
    """Each left row with the right row at or before its ``on`` (forward: at or after), as struct columns of the left.

    Both sides are stacked and sorted once by key and time; equal times match. ``tolerance``: a condition on the left's
    ``on`` and the match's ``_on``, where it is false the match is null.
    """
    value = F.struct(F.col(on).alias("_on"), *columns)
    stacked = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)).unionByName(
        right.select(key, on, value.alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    if forward:
        w = Window.partitionBy(key).orderBy(F.col(on).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(key).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = stacked.withColumn("_match", F.last("_value", True).over(w)).where("_side = 1")
    fine = met["_match"].isNotNull() if tolerance is None else F.coalesce(tolerance, F.lit(False))
    met = met.withColumn("_on", F.col("_match._on"))
    return met.select(*left.columns, F.when(fine, F.col("_on")).alias(f"matched_{on}"), *(F.when(fine, F.col(f"_match.{c}")).alias(c) for c in columns))


def in_window(points: DataFrame, events: DataFrame, days_before: int, days_after: int) -> DataFrame:
    """Points of a symbol with an event within days_before back to days_after ahead: equi-join on symbol and month bucket.

    Each event is put in the buckets that its window touches, so a symbol with many events is spread over buckets.
    """
    size = 30
    spread = events.select("symbol", F.col("date").alias("_event")).distinct()
    spread = spread.withColumn("_bucket", F.explode(F.sequence(F.floor(F.unix_date(F.date_sub("_event", days_after)) / size), F.floor(F.unix_date(F.date_add("_event", days_before)) / size))))
    bucketed = points.withColumn("_bucket", F.floor(F.unix_date("date") / size))
    near = (F.col("_event") >= F.date_sub("date", days_before)) & (F.col("_event") <= F.date_add("date", days_after))
    return bucketed.join(spread, ["symbol", "_bucket"]).where(near).groupBy("symbol", "date").agg(F.max("_event").alias("last_event"), F.count("*").alias("n_events"))


def pairs(rows: DataFrame, within: list[str], value: str) -> DataFrame:
    """Values of two symbols a < b of the same cluster at the same date."""
    a = rows.select(*within, F.col("symbol").alias("a"), F.col(value).alias("x"))
    b = rows.select(*within, F.col("symbol").alias("b"), F.col(value).alias("y"))
    return a.join(b, within).where("a < b")


def outer_fill(parts: dict[str, DataFrame]) -> DataFrame:
    """All dates of several (date, value) tables; each column carries its last value forward."""
    spine = None
    for frame in parts.values():
        dates = frame.select("date")
        spine = dates if spine is None else spine.union(dates)
    out = spine.distinct()
    for name, frame in parts.items():
        out = out.join(frame.select("date", F.col("value").alias(name)), "date", "left")
    # One series of dates: bounded by the calendar, not by the data.
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("date", *(F.last(n, True).over(w).alias(n) for n in parts))
