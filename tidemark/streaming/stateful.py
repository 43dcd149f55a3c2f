"""Streams whose micro-batches update stored tables: latched drawdowns per user, and daily bars with late rows counted and
corrected. A batch's results and its state are stored under its number, so that a repeated batch writes the same again; a batch is
handled with DataFrame operations only, by user and day, so that no user's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: State of a user: the highest value so far, and whether a fall by the limit was ever seen.
PEAKS = "user_id long, peak double, latched boolean"
MARKS = "batch long, n_rows long, n_late long, newest timestamp"
_so_far = (Window.unboundedPreceding, 0)


def _each_batch(events: DataFrame, folder: str, step) -> None:
    events.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


# -- latched drawdowns ------------------------------------------------------------------------------------------


def _before(daily: DataFrame, column: str) -> DataFrame:
    """The largest value of a column over the user's days before each; one row a user and day."""
    return daily.withColumn("_before", F.max(column).over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)))


def drawdown_step(rows: DataFrame, peaks: DataFrame, limit: float) -> DataFrame:
    """(event_id, ts, user_id, value) and the state before -> peak so far and whether a fall by ``limit`` from it was ever seen,
    for each row. Peaks pass from day to day, then latches do."""
    rows = rows.withColumn("day", F.to_date("ts"))
    within = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(*_so_far)
    highest = _before(rows.groupBy("user_id", "day").agg(F.max("value").alias("high")), "high").drop("high")
    carried = highest.join(peaks, "user_id", "left").select("user_id", "day", F.greatest("_before", "peak").alias("_peak"), F.coalesce("latched", F.lit(False)).alias("_latched"))
    out = rows.join(carried, ["user_id", "day"]).withColumn("peak", F.greatest(F.max("value").over(within), "_peak"))
    out = out.withColumn("_fell", F.coalesce(F.col("value") <= F.col("peak") * (1 - limit), F.lit(False)))
    fallen = _before(out.groupBy("user_id", "day").agg(F.max("_fell").alias("fell")), "fell").select("user_id", "day", F.coalesce("_before", F.lit(False)).alias("_earlier"))
    latched = F.col("_latched") | F.col("_earlier") | F.max("_fell").over(within)
    return out.join(fallen, ["user_id", "day"]).select("event_id", "user_id", "ts", "value", "peak", latched.alias("latched"))


def latched_drawdown(events: DataFrame, limit: float, folder: str) -> DataFrame:
    """Drain a stream of events; returns every row with its peak so far and latch."""
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(PEAKS).parquet(f"{folder}/peaks-{number - 1}") if number else spark.createDataFrame([], PEAKS)
        path = f"{folder}/rows/batch={number}"
        drawdown_step(batch.select("event_id", "ts", "user_id", "value"), before, limit).write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path).groupBy("user_id").agg(F.max("peak").alias("peak"), F.max("latched").alias("latched"))
        kept = before.unionByName(done).groupBy("user_id").agg(F.max("peak").alias("peak"), F.max("latched").alias("latched"))
        kept.write.mode("overwrite").parquet(f"{folder}/peaks-{number}")

    _each_batch(events, folder, step)
    return spark.read.schema("event_id long, user_id long, ts timestamp, value double, peak double, latched boolean, batch int").parquet(f"{folder}/rows").drop("batch")


# -- late rows --------------------------------------------------------------------------------------------------


def daily(rows: DataFrame) -> DataFrame:
    """Bars of each user and day."""
    order = F.struct("ts", "event_id")
    return rows.groupBy("day", "user_id").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))


def land(events: DataFrame, folder: str, delay: str) -> DataFrame:
    """Drain a stream into stored rows by day. A row is late if it is older, by more than ``delay``, than the newest row of the
    batches before its own. Returns (batch, n_rows, n_late, newest): how many rows of each batch were late, as it observed."""
    spark = events.sparkSession
    schema = events.schema

    def step(batch: DataFrame, number: int) -> None:
        seen = spark.read.schema(MARKS).parquet(f"{folder}/marks").where(F.col("batch") < number).agg(F.max("newest")).first()[0] if number else None
        mark = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        tagged = batch.select(*schema.names, F.to_date("ts").alias("day"), F.coalesce(F.col("ts") < mark, F.lit(False)).alias("late"))
        told = Observation(f"batch-{number}")
        tagged = tagged.observe(told, F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("n_late"), F.max("ts").alias("newest"))
        tagged.write.mode("overwrite").partitionBy("late", "day").parquet(f"{folder}/rows/batch={number}")
        now = told.get
        spark.createDataFrame([(number, now["n_rows"], now["n_late"], now["newest"])], MARKS).write.mode("overwrite").parquet(f"{folder}/marks/part={number}")

    _each_batch(events, folder, step)
    return spark.read.schema(MARKS).parquet(f"{folder}/marks")


def landed(events_schema: str, spark: SparkSession, folder: str) -> DataFrame:
    """The rows that ``land`` stored, with day and late."""
    return spark.read.schema(f"{events_schema}, day date, late boolean, batch int").parquet(f"{folder}/rows")


def publish(rows: DataFrame, table: str) -> None:
    """Bars of the rows that came in time, a folder for each day."""
    daily(rows.where("not late")).repartition("day").write.mode("overwrite").partitionBy("day").parquet(table)


def correct(rows: DataFrame, table: str) -> None:
    """Bars of the days that got late rows, from all rows of those days; only their folders are replaced."""
    touched = rows.where("late").select("day").distinct()  # bounded by the calendar
    fixed = daily(rows.join(F.broadcast(touched), "day", "left_semi"))
    fixed.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)


def read_bars(spark: SparkSession, table: str) -> DataFrame:
    columns = "day date, user_id long, open double, high double, low double, close double, n long"
    return spark.read.schema(columns).parquet(table).select(*(c.split()[0] for c in columns.split(", ")))


def arrive(events: DataFrame, folder: str, files: int, delayed: Column, days: int) -> None:
    """Write events as a landing folder in the order in which they arrive: by day, ``delayed`` ones ``days`` days later."""
    arrival = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) + F.when(delayed, days).otherwise(0)
    rows = events.withColumn("_at", arrival)
    low, high = rows.agg(F.min("_at"), F.max("_at")).first()
    width = max((high - low) // files + 1, 1) if low is not None else 1
    for k in range(files if low is not None else 0):  # one after the other: a stream takes files by their times
        part = rows.where(F.col("_at").between(low + k * width, low + (k + 1) * width - 1)).drop("_at")
        part.coalesce(1).write.mode("append").parquet(folder)
