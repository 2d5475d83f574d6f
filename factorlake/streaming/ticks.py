"""Ticks: JSON messages from a topic or files, parsed, deduplicated by (symbol, timestamp), landed; bars rolled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factorlake.functions.scalar import parse_time

PRICES = ("open", "high", "low", "close", "volume")
MESSAGE = "symbol string, timestamp string, " + ", ".join(f"{p} double" for p in PRICES)


def tick_stream_read(spark: SparkSession, folder: str | None = None, servers: str | None = None, topic: str = "market_ticks", per_trigger: int | None = None) -> DataFrame:
    """A stream of messages (value string): from a topic (needs the connector on the class path) or from a folder of text files."""
    if servers:
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()
        return stream.select(F.col("value").cast("string").alias("value"))
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(folder)


def tick_parse(messages: DataFrame) -> DataFrame:
    """(symbol, timestamp, prices, value): missing prices are 0; symbol and timestamp are null where they can't be read."""
    row = F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"})
    parsed = messages.select("value", row.alias("m"))
    return parsed.select(F.nullif(F.trim("m.symbol"), F.lit("")).alias("symbol"), parse_time(F.col("m.timestamp")).alias("timestamp"), *[F.coalesce(F.col(f"m.{p}"), F.lit(0.0)).alias(p) for p in PRICES], "value")


def filter_valid_ticks(ticks: DataFrame) -> DataFrame:
    return ticks.where("symbol is not null and timestamp is not null").drop("value")


def tick_quarantine(ticks: DataFrame) -> DataFrame:
    """The messages that could not be read."""
    return ticks.where("symbol is null or timestamp is null").select("value")


def tick_upsert(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """Valid ticks, the first of each (symbol, timestamp) within the watermark."""
    valid = filter_valid_ticks(ticks)
    return valid.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["symbol", "timestamp"])


def sink_ticks(ticks: DataFrame, path: str, checkpoint: str, dead: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch appends keys the table has not got yet, partitioned by date, and unreadable messages to ``dead``.

    A batch is written under its number, so one that runs again after a failure replaces what it wrote. Only the dates that it
    spans are read of the table: what has landed before them costs a micro-batch nothing.
    """

    def land(batch: DataFrame, number: int) -> None:
        batch.persist()
        spark = batch.sparkSession
        new = filter_valid_ticks(batch).dropDuplicates(["symbol", "timestamp"]).withColumn("date", F.to_date("timestamp"))
        try:
            span = new.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
            held = spark.read.parquet(path).where((F.col("batch") != number) & F.col("date").between(F.lit(span["first"]), F.lit(span["last"]))).select("symbol", "timestamp", "date")
            new = new.join(held, ["symbol", "timestamp", "date"], "left_anti")
        except Exception as error:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "date").parquet(path)
        if dead:
            tick_quarantine(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(dead)
        batch.unpersist()

    writer = ticks.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tick_publish(ticks: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    body = ticks.select(F.col("symbol").alias("key"), F.to_json(F.struct("symbol", "timestamp", *PRICES)).alias("value"))
    return body.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def bars_from_ticks(ticks: DataFrame, width: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """Tumbling bars (symbol, timestamp, OHLCV) of ticks (symbol, timestamp, close, volume); a stream emits a bar when the watermark (``late``; None: it has one) has passed it."""
    if ticks.isStreaming and late is not None:
        ticks = ticks.withWatermark("timestamp", late)
    made = ticks.groupBy(F.window("timestamp", width), "symbol").agg(
        F.min_by("close", "timestamp").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume")
    )
    return made.select("symbol", F.col("window.start").alias("timestamp"), *PRICES)
