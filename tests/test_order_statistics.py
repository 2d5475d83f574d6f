"""Rolling and whole-column quantiles against numpy, with gaps, ties, infinities and extreme ranges."""

import math

import numpy as np
import pandas as pd
import pytest

from factorlake.functions import order_statistics as O
from factorlake.operators import causal, research


@pytest.mark.parametrize("n, least", [(1, 1), (5, 2), (60, 10), (300, 10)])
def test_rolling_quantiles_equal_numpy(n, least):
    r = np.random.default_rng(n)
    x = np.where(r.random(250) < 0.3, np.nan, np.round(r.normal(0, 2, 250), 1))
    got = O.rolling_quantiles(x, n, least, [0.0, 0.01, 0.5, 0.99, 1.0])
    for i in range(250):
        held = x[max(0, i - n + 1) : i + 1]
        held = held[~np.isnan(held)]
        if len(held) < least:
            assert np.isnan(got[i]).all()
        else:
            assert np.allclose(got[i], np.quantile(held, [0.0, 0.01, 0.5, 0.99, 1.0]))


@pytest.mark.parametrize("name", ["normal", "ties", "one", "wide", "infinite", "tiny", "two"])
def test_selection_is_exact(spark, name):
    r = np.random.default_rng(3)
    x = {
        "normal": r.normal(0, 1, 5_001), "ties": r.integers(0, 4, 3_000).astype(float), "one": np.array([7.5]), "wide": np.concatenate([10.0 ** r.integers(-30, 30, 500), -(10.0 ** r.integers(-30, 30, 500))]),
        "infinite": np.array([-math.inf, -1.7976931348623157e308, -1.0, 2.0, 1.7976931348623157e308, math.inf, math.inf]), "tiny": np.array([0.0, 5e-324, 1e-323, 1.0]), "two": np.array([1.0, 2.0]),
    }[name]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    ranks = sorted({0, len(x) // 3, len(x) // 2, len(x) - 1})
    assert O.order_statistics(df, "x", ranks) == {k: sorted(x)[k] for k in ranks}
    if name != "infinite":
        assert O.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0]) == pytest.approx(np.quantile(x, [0.0, 0.25, 0.5, 1.0]).tolist(), rel=1e-12)


def test_selection_without_values(spark):
    assert O.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
    with pytest.raises(ValueError):
        O.order_statistics(spark.createDataFrame([(1.0,)], "x double"), "x", [1])
    assert causal.binarise_median(spark.createDataFrame([(None,)], "x double"), "x").first().treatment == 0
    assert causal.rosenbaum_bounds(spark.createDataFrame([(1, 2.0)], "t int, y double"), "t", "y", [1.0]).first().p_high == 1.0


def test_winsorized_columns_equal_pandas(spark):
    r = np.random.default_rng(4)
    rows = [((pd.Timestamp("2020-01-01") + pd.Timedelta(days=d)).to_pydatetime(), t, None if r.random() < 0.2 else float(r.standard_t(2)), float(r.normal()), "extra") for t in ("a", "b", "short") for d in range(5 if t == "short" else 120)]
    df = spark.createDataFrame(rows, "date timestamp, ticker string, x double, y double, note string").repartition(4)
    got = research.winsorize_rolling(df, ["x", "y"], n=30).toPandas().sort_values(["ticker", "date"])
    want = df.toPandas().sort_values(["ticker", "date"])
    for c in ("x", "y"):
        for _, g in want.groupby("ticker"):
            roll = g[c].rolling(30, min_periods=10)
            low, high = (roll.quantile(q).fillna(g[c].quantile(q)) for q in (0.01, 0.99))
            assert np.allclose(got.loc[got.ticker == g.ticker.iloc[0], c].to_numpy(), g[c].clip(low, high).to_numpy(), equal_nan=True)
    assert set(got.note) == {"extra"} and list(got.columns) == list(want.columns)
