"""Streaming forms of the periodic refreshes.

Each job reads a directory as a stream, processes what is available and writes a
Parquet table below the shared folder, where its checkpoint also lives; a rerun
after a lost executor or a restart continues from that checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brickline.functions.labels import sentiment_label
from brickline.session import new_table_path

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
# Event value to score in about -0.5 .. and up.
SCORE_SCALE, SCORE_SHIFT = 10, 0.5
# Days after the last event at which the marker of an ended input lies; more than any window and delay.
AFTER_DAYS = 400


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream with its city and an event-time timestamp.

    The pattern matches the table both as one file and as a directory of parts.
    """
    return _with_city(spark.readStream.schema(EVENT_SCHEMA).parquet(f"{folder}/events.parque[t]"))


def _with_city(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "city", F.concat(F.lit("NATION_"), F.pmod("user_id", F.lit(25)).cast("string"))
    )


def run_available(spark: SparkSession, start: Callable[[DataStreamWriter], DataStreamWriter], df: DataFrame, path: str) -> None:
    """Run to the end of the available input with the checkpoint next to the output."""
    writer = df.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    query = start(writer).start()
    query.awaitTermination()


def to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    path = new_table_path(spark, name)
    run_available(spark, lambda w: w.format("parquet").outputMode(mode).option("path", path), df, path)
    return spark.read.parquet(path)


def closed_table(spark: SparkSession, folder: str, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """A windowed job over the whole event table, with the windows that are open when the input ends.

    First everything available is read. Then one marker event, far later than any other, is added beside the table and
    the query goes on from its checkpoint: the marker moves the watermark past every window, and its own never closes.
    The input counts as ended then; events that come later are late.
    """
    path = new_table_path(spark, name)
    marks = f"{path}-marks"
    spark.createDataFrame([], EVENT_SCHEMA).write.parquet(marks)

    def run() -> None:
        events = event_stream(spark, folder).unionByName(_with_city(spark.readStream.schema(EVENT_SCHEMA).parquet(marks)))
        run_available(spark, lambda w: w.format("parquet").outputMode("append").option("path", path), job(events), path)

    run()
    last = spark.read.schema(EVENT_SCHEMA).parquet(f"{folder}/events.parquet").agg(F.max("ts").alias("ts")).filter("ts is not null")
    last.select(
        F.lit(None).cast("bigint").alias("event_id"),
        (F.col("ts") + F.expr(f"interval {AFTER_DAYS} days")).alias("ts"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"))],
    ).write.mode("append").parquet(marks)
    run()
    return spark.read.schema(job(event_stream(spark, folder)).schema).parquet(path)


def daily_sentiment_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mean score per day and city in event time; rows later than the delay are dropped."""
    score = F.col("value") / SCORE_SCALE - SCORE_SHIFT
    day = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "city")
        .agg(F.round(F.round(F.avg(score), 9), 2).alias("sentiment_score"))
    )
    return day.select(
        F.col("window.start").cast("date").alias("date"),
        "city",
        "sentiment_score",
        sentiment_label(F.col("sentiment_score")).alias("sentiment_label"),
    )


def rolling_mean_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Three-day mean moving by one day per city."""
    out = events.withWatermark("ts", delay).groupBy(F.window("ts", "3 days", "1 day"), "city").agg(
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n")
    )
    return out.select(F.col("window.start").cast("date").alias("first_day"), "city", "mean_value", "n")


def sessions_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions per user closed by a gap."""
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")
    )
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n_events", "total")


def dedupe_stream(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """First event per key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
