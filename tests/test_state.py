"""Streams with state against the same work in one batch: alarms over micro-batches, late and repeated ticks."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from factorlake.operators import regime
from factorlake.streaming import state
from factorlake.streaming import ticks as T

DAY = datetime(2024, 1, 1)


def test_alarms_over_micro_batches_equal_the_batch(spark):
    r = np.random.default_rng(1)
    rows = [(t, DAY + timedelta(days=d), float(r.normal(0, 1) + (2 if 40 < d < 50 else 0))) for t in ("a", "b", "c") for d in range(90)]
    rows += [("short", DAY + timedelta(days=d), float(d)) for d in range(4)] + [("flat", DAY + timedelta(days=d), 1.0) for d in range(90)] + [("a", DAY + timedelta(days=200), None)]
    series = spark.createDataFrame(rows, "ticker string, date timestamp, value double")
    limits = state.cusum_limits(series)
    assert {x.ticker for x in limits.collect()} == {"a", "b", "c"}
    bounds = [0, 10, 45, 46, 400]
    pieces = [series.where((F.col("date") >= F.lit(DAY + timedelta(days=a))) & (F.col("date") < F.lit(DAY + timedelta(days=b)))) for a, b in zip(bounds, bounds[1:])]
    made, _ = state.replay([*pieces, pieces[0]], lambda stream: state.cusum_stream(stream, limits))  # the first dates once more: passed over
    key = lambda df: sorted((x.ticker, x.date, x.side) for x in df.collect())
    assert key(made) == key(regime.cusum(series)) and made.count() > 3


def test_late_ticks_change_their_bar_within_the_watermark(spark):
    tick = lambda s, day, hour, price: (s, DAY + timedelta(days=day, hours=hour), price, 1.0)
    form = "symbol string, timestamp timestamp, close double, volume double"
    one = spark.createDataFrame([tick("x", 0, 1, 10.0), tick("x", 0, 5, 12.0), tick("x", 0, 5, 12.0), tick("y", 1, 1, 5.0)], form)
    two = spark.createDataFrame([tick("x", 0, 3, 99.0), tick("x", 0, 1, 10.0), tick("x", 6, 0, 1.0)], form)  # 28 hours late at most: within two days
    three = spark.createDataFrame([tick("x", 0, 4, 500.0), tick("z", 3, 0, 7.0), tick("y", 5, 0, 8.0)], form)  # the first two are behind day 4
    end = spark.createDataFrame([tick("", 100, 0, 0.0)], form)
    bars, dropped = state.replay([one, two, three, end], lambda stream: state.late_bars(stream, late="2 days"))
    kept = one.unionByName(two).unionByName(three.where("symbol = 'y'")).dropDuplicates(["symbol", "timestamp"])
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(bars) == key(T.bars_from_ticks(kept)) and dropped == 2
    assert [x.high for x in bars.where("symbol = 'x' and timestamp = '2024-01-01'").collect()] == [99.0]
