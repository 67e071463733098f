"""Bars of a tick stream: tumbling windows that close behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_path


def streaming_bars(ticks: DataFrame, window: str = "1 hour", lateness: str | None = "1 hour") -> DataFrame:
    """OHLCV windows of ``ticker, ts, price, size, order``; ticks later than ``lateness`` are left out.

    Without ``lateness`` the stream must have its watermark already, as one of
    :func:`once_only` has.

    A window is the streaming form of a completed session: in append mode it
    leaves once, when the watermark has passed its end.
    """
    seen = ticks if lateness is None else ticks.withWatermark("ts", lateness)
    grouped = seen.groupBy("ticker", F.window("ts", window).alias("w")).agg(
        F.min_by("price", "order").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "order").alias("close"), F.sum("size").alias("volume")
    )
    return grouped.select("ticker", F.col("w.start").alias("session"), "open", "high", "low", "close", "volume")


def once_only(ticks: DataFrame, key: str = "order", lateness: str = "1 hour") -> DataFrame:
    """Ticks without repeats of ``key`` that arrive within ``lateness``."""
    return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def event_ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(100.0) + F.col("value") / 50.0).alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("order"))


def replay_events(spark: SparkSession, sf_dir: str, lateness: str = "1 hour") -> DataFrame:
    """The events table as a stream of files, run to its end; the bars as a table.

    Windows leave in append mode, when the watermark has passed them, into
    files of the shared folder.  A last tick far behind the others, of no
    ticker, lets the watermark pass all of them.
    """
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = event_ticks(batch)
    folder = shared_path(spark, "stream")
    last = ticks.agg(F.max("ts").alias("ts")).where("ts is not null").select(F.lit(None).cast("string").alias("ticker"), (F.col("ts") + F.expr("interval 10 years")).alias("ts"), F.lit(0.0).alias("price"), F.lit(0.0).alias("size"), F.lit(-1).cast("long").alias("order"))
    last.write.parquet(f"{folder}/last")
    # a file stream reads a folder: the pattern names the one table
    stream = event_ticks(spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*"))
    stream = stream.unionByName(spark.readStream.schema(ticks.schema).parquet(f"{folder}/last"))
    bars = streaming_bars(stream, lateness=lateness)
    query = bars.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/bars")
    query.awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{folder}/bars").where("ticker is not null")
