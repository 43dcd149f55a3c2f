"""Structured Streaming versions of bars, order flow, deduplication and alerts over an event stream.

Every function takes and returns a streaming DataFrame; late rows beyond the watermark are dropped by the engine. ``stateful``
counts them and corrects what they belong to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1000) -> DataFrame:
    """Parquet files of events as they land in a folder, at most ``files`` in a micro-batch."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def bars(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close and count of each user's values per tumbling window."""
    rows = events.withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    return rows.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))


def order_flow(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    side = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    rows = events.where("event_type = 'purchase'").withWatermark("ts", late)
    return rows.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.sum(side * F.get_json_object("props", "$.k").cast("double")).alias("flow"))


def first_seen(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def alerts(events: DataFrame, limit: float) -> DataFrame:
    return events.where(F.col("value") > limit).select("event_id", "user_id", "value", F.when(F.col("value") > 2 * limit, "critical").otherwise("warning").alias("level"))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain what is there now into a stored table: append through the file sink, else the last complete result."""
    spark = stream.sparkSession
    path, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def flow_by_second(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Signed volume and trades of each second."""
    side = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    rows = events.where("event_type = 'purchase'").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 second").alias("w")).agg(F.sum(side * F.get_json_object("props", "$.k").cast("double")).alias("flow"), F.count("*").alias("n"))


def sliding(events: DataFrame, width: str = "3 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, extremes and count of each user's values over sliding windows: the features of the latest rows."""
    rows = events.withWatermark("ts", late)
    return rows.groupBy("user_id", F.window("ts", width, step).alias("w")).agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def with_anchor(events: DataFrame, anchors: DataFrame, fresh_days: int) -> DataFrame:
    """Each event with its user's stored daily anchor (user_id, day, anchor) of the day before, unless that is older than allowed.

    A stream-static join: the anchors are read again for each micro-batch, so a new day's table is seen without a restart.
    """
    rows = events.withColumn("_day", F.date_sub(F.to_date("ts"), 1))
    known = anchors.select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(fresh_days)), lambda k: F.date_add("day", k.cast("int")))).alias("_day"), "day", "anchor")
    met = rows.join(known, ["user_id", "_day"], "left")
    return met.select("event_id", "user_id", "day", "anchor")


def liquid_universe(events: DataFrame, folder: str, k: int) -> DataFrame:
    """After each micro-batch the k users with the most traded volume so far, stored by batch; returns the last one's.

    The volumes are kept as a table that each batch adds to, so a batch only reads its own rows and one row per user.
    """
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        now = batch.where("event_type = 'purchase'").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("double")).alias("volume"))
        if number:
            now = now.unionByName(spark.read.schema("user_id long, volume double").parquet(f"{folder}/volumes-{number - 1}")).groupBy("user_id").agg(F.sum("volume").alias("volume"))
        now.write.mode("overwrite").parquet(f"{folder}/volumes-{number}")
        best = spark.read.schema("user_id long, volume double").parquet(f"{folder}/volumes-{number}").orderBy(F.desc("volume"), "user_id").limit(k)
        best.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/universe/batch={number}")

    events.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    rows = spark.read.schema("user_id long, volume double, batch int").parquet(f"{folder}/universe")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").select("user_id", "volume")


def prevailing_quotes(quotes: DataFrame, late: str = "1 hour") -> DataFrame:
    """The latest quote of each user within each day, as it stands now; update mode re-emits a user's row when a newer quote comes."""
    rows = quotes.where("event_type = 'view'").withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    return rows.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.max_by("value", order).alias("mid"), F.max("ts").alias("quoted"), F.max_by("event_id", order).alias("event_id"))
