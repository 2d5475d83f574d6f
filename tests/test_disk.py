"""What stored tables and whole matrices leave on disk, and what they send."""

import gc
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from factorlake.functions.staging import FREED, cut
from factorlake.plans import matrix


def tables(spark, tickers=6, days=90):
    r = np.random.default_rng(8)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(days=d), f"t{t}", *map(float, r.uniform(5, 9, 4)), float(r.integers(1, 99))) for t in range(tickers) for d in range(days) if (d + t) % 9]
    bars = spark.createDataFrame(rows, "date timestamp, ticker string, open double, high double, low double, close double, volume double").withColumn("adj_close", F.col("close"))
    names = "pe_ratio, pb_ratio, roe, roa, gross_margin, earnings_yield, debt_equity, current_ratio, asset_growth, accruals, ev_ebitda, dividend_yield, log_market_cap".split(", ")
    # report dates on, between and after the bars' dates
    reports = [(start + timedelta(days=d, hours=h), f"t{t}", *map(float, r.uniform(1, 9, len(names))), f"s{t % 2}") for t in range(tickers + 1) for d, h in ((0, 0), (20, 0), (41, 5), (60, 0), (days + 5, 0))]
    return bars, spark.createDataFrame(reports, f"date timestamp, ticker string, {', '.join(f'{n} double' for n in names)}, sector string")


def test_a_stored_table_leaves_no_shuffle_files(spark):
    gc.collect()
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before, conf = tracker.shuffleStatuses().size(), spark.conf.get(FREED, None)
    rows = cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert tracker.shuffleStatuses().size() <= before and spark.conf.get(FREED, None) == conf
    assert rows.agg(F.sum("s")).first()[0] == 499500


def test_composites_equal_those_of_the_joined_matrix_without_its_join(spark):
    bars, fundamentals = tables(spark)
    grid = matrix.staged(bars)
    made = matrix.plans(bars, fundamentals, grid)
    rows, names = matrix.composites(made)
    assert "FullOuter" not in rows._jdf.queryExecution().optimizedPlan().toString()
    joined = matrix.P.join_features_outer([matrix.rows_of(family, plan) for family, plan in made.items()])
    layers, _ = matrix.families.composite([n for _, _, own in made.values() for n in own if n.startswith(("rank_", "zscore_"))])
    want = matrix.apply_layers(joined, layers, [*matrix.KEY, *names])
    key = lambda df: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*matrix.KEY, *names).collect())
    got, want = key(rows), key(want)
    assert len(got) > 450 and len(got) == len(want)
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and (abs(a - b) < 1e-8 or (a != a and b != b)))
    assert all(same(a, b) for g, w in zip(got, want) for a, b in zip(g, w))


def test_parts_in_buckets_of_their_key_join_without_an_exchange(spark):
    from factorlake.sources.sinks import keyed_part

    rows = spark.range(200).select(F.concat_ws("|", F.col("id").cast("string"), F.lit("t")).alias("row"), F.col("id").cast("int").alias("a"))
    whole, part = keyed_part(rows, "row", 4), keyed_part(rows.where("a % 3 = 0").withColumnRenamed("a", "b"), "row", 4)
    joined = whole.join(part.hint("merge"), "row", "left")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.agg(F.count("*"), F.sum("a"), F.count("b"), F.sum("b")).first()[:] == (200, 19900, 67, 6633)
