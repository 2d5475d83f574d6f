"""Windows put together from short ones equal plain frames: infinities, large offsets, gaps, long series."""

import math

import numpy as np
import pandas as pd
import pytest

from factorlake.functions import doubling, kernels

AGGS = ["count", "sum", "avg", "var_samp", "stddev_samp", "max", "min", "covar_samp", "regr_slope"]


def frame_of(spark, x, y=None, tickers=1):
    rows = [(t, i, float(a) if a is not None else None, float(b) if b is not None else None) for t in range(tickers) for i, (a, b) in enumerate(zip(x, x if y is None else y))]
    return spark.createDataFrame(rows, "ticker int, date int, x double, y double")


def both(df, n):
    windows = [(agg, ("x", "y") if agg in ("covar_samp", "regr_slope") else ("x",), n) for agg in AGGS]
    got = doubling.add(df, windows)
    frame = kernels.frame(n)
    plain = {agg: f"{agg}({'y, x' if len(xs) == 2 else 'x'}) {frame}" for agg, xs, _ in windows}
    return got.selectExpr("ticker", "date", *[f"{doubling.name(w)} AS got_{w[0]}" for w in windows], *[f"{sql} AS want_{agg}" for agg, sql in plain.items()]).toPandas()


def same(a, b, scale):
    if a is None or b is None or pd.isna(a) and pd.isna(b):
        return pd.isna(a) == pd.isna(b)
    if math.isinf(a) or math.isinf(b):
        return a == b
    return abs(a - b) <= 1e-9 * max(abs(a), abs(b)) + scale


@pytest.mark.parametrize("n", [33, 48, 60, 63, 100, 120, 126, 200, 252, 256])
def test_equals_plain_frames_with_gaps(spark, n):
    r = np.random.default_rng(n)
    x = [None if r.random() < 0.3 else v for v in r.normal(0, 1, 400)]
    y = [None if r.random() < 0.3 else v for v in r.normal(5, 2, 400)]
    made = both(frame_of(spark, x, y, 2), n)
    for agg in AGGS:
        assert all(same(a, b, 1e-9) for a, b in zip(made[f"got_{agg}"], made[f"want_{agg}"])), agg


def test_an_infinity_does_not_outlive_its_window(spark):
    x = np.arange(600, dtype=float) % 7
    x[100] = np.inf
    x[400] = -np.inf
    made = both(frame_of(spark, x), 60).sort_values("date")
    for agg in ("sum", "avg", "max", "min", "var_samp"):
        assert all(same(a, b, 1e-9) for a, b in zip(made[f"got_{agg}"], made[f"want_{agg}"])), agg
    assert np.isfinite(made.got_var_samp[160:400].astype(float)).all()


def test_large_offsets_and_sums_before(spark):
    r = np.random.default_rng(1)
    offset = both(frame_of(spark, 1e12 + r.normal(0, 1000, 500)), 252)
    assert np.allclose(offset.got_stddev_samp[1:].astype(float), offset.want_stddev_samp[1:].astype(float), rtol=1e-6)
    x = np.concatenate([np.full(50, 1e18), r.normal(0, 1e-3, 600)])
    made = both(frame_of(spark, x), 120)
    assert all(same(a, b, 1e-15) for a, b in zip(made.got_sum[200:], made.want_sum[200:]))
    assert np.allclose(made.got_stddev_samp[200:].astype(float), made.want_stddev_samp[200:].astype(float), rtol=1e-9)


def test_ten_thousand_dates(spark):
    r = np.random.default_rng(2)
    made = both(frame_of(spark, r.lognormal(0, 3, 10_000), r.normal(0, 1, 10_000)), 252)
    for agg in AGGS:
        assert all(same(a, b, 1e-9) for a, b in zip(made[f"got_{agg}"], made[f"want_{agg}"])), agg


def test_one_exchange_and_one_sort(spark):
    df = frame_of(spark, range(50))
    plan = doubling.add(df, [(agg, ("x",), n) for agg in ("avg", "stddev_samp", "max") for n in (60, 252)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_pieces_make_up_the_window():
    for n in range(doubling.PLAIN + 1, 600):
        made = doubling.pieces(n)
        assert sum(w for w, _ in made) == n and [b for _, b in made] == [0, *np.cumsum([w for w, _ in made])[:-1].tolist()]
