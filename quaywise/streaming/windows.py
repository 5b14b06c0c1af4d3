"""Streams: event-time windows with watermarks, duplicates, sessions, point-in-time enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, name: str = "*.parquet") -> DataFrame:
    """A stream of Parquet files of a folder; zoneless times become instants, which watermarks need."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_means(events: DataFrame, width: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Mean value by type and tumbling window; rows later than ``late`` are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once, remembered for the watermark's span."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def enriched(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A stream joined to a static table."""
    return events.join(dimension, key, "left")


def drain(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, write its rows to the folder ``out`` and read them there.

    A batch that is tried again replaces its own rows; in complete mode the newest batch replaces all.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/all" if mode == "complete" else f"{out}/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"{out}/all" if mode == "complete" else f"{out}/batch=*")
