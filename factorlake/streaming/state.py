"""Streams with keyed state: alarms of a cumulative sum, bars of deduplicated late ticks, and replays of tables as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factorlake.functions.staging import shared_folder
from factorlake.streaming import ticks as T


def cusum_limits(history: DataFrame, least: int = 10) -> DataFrame:
    """(ticker, mean, deviation) of history(ticker, value): what a stream's values are standardised by; short or flat series have none."""
    stats = history.groupBy("ticker").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return stats.where((F.col("n") >= least) & (F.col("deviation") >= 1e-10)).select("ticker", "mean", "deviation")


def cusum_stream(series: DataFrame, limits: DataFrame, drift: float = 0.5, threshold: float = 3.0, late: str = "0 seconds", expiry_days: int = 400) -> DataFrame:
    """(ticker, date, side): alarms of a stream (ticker, date, value) by two sums a ticker, kept as state and set back by an alarm.

    A micro-batch's values are folded in order of date; one that is not after the last date folded for its ticker comes too late and is
    passed over. A ticker without values for ``expiry_days`` of event time loses its state. Tickers without limits have no alarms.
    """
    rows = series.where("value is not null").withWatermark("date", late).join(limits, "ticker").select("ticker", "date", ((F.col("value") - F.col("mean")) / F.col("deviation")).alias("z"))

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        up, down, last = state.get if state.exists else (0.0, 0.0, None)
        new = pd.concat(list(frames)).sort_values("date", kind="stable")
        new = new if last is None else new[new.date > last]
        dates, sides = [], []
        for date, z in zip(new.date, new.z, strict=True):
            up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
            if up > threshold or down > threshold:
                dates.append(date)
                sides.append("up" if up > threshold else "down")
                up = down = 0.0
        last = new.date.max() if len(new) else last
        state.update((up, down, last))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + expiry_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"ticker": [key[0]] * len(dates), "date": pd.Series(dates, dtype="datetime64[ns]"), "side": pd.Series(sides, dtype=object)})

    return rows.groupBy("ticker").applyInPandasWithState(fold, "ticker string, date timestamp, side string", "up double, down double, last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def late_bars(ticks: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Bars of a stream of valid ticks, each (symbol, timestamp) once; a tick behind the watermark changes nothing, one within it its bar."""
    return T.bars_from_ticks(ticks.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["symbol", "timestamp"]), width, late=None)


def replay(slices: list[DataFrame], plan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(what plan(stream) appends, rows that state operators dropped behind the watermark) over slices that arrive one after the other.

    Each slice is a micro-batch of its own run, which starts from the state that the run before it left in the shared folder.
    """
    spark = slices[0].sparkSession
    base, dropped = f"{shared_folder(spark)}/replay-{uuid4().hex}", 0
    for piece in slices:
        piece.write.mode("append").parquet(f"{base}/in")
        made = plan(spark.readStream.schema(piece.schema).parquet(f"{base}/in"))
        query = made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return spark.read.schema(made.schema).parquet(f"{base}/out"), dropped
