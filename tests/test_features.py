"""Feature families against pandas on a small panel with holes, and their sizes and edge rules."""

import numpy as np
import pandas as pd
import pytest

from factorlake.functions import kernels as K
from factorlake.operators import panel as P
from factorlake.plans import features as families
from factorlake.plans import matrix


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(7)
    dates, tickers = pd.bdate_range("2023-01-02", periods=90), [f"T{i}" for i in range(5)]
    close = pd.DataFrame(100 * np.exp(np.cumsum(rng.normal(0.0003, 0.015, (90, 5)), axis=0)), index=dates, columns=tickers)
    volume = pd.DataFrame(rng.uniform(1e5, 1e7, (90, 5)), index=dates, columns=tickers)
    close.iloc[30:33, 1] = np.nan
    return close, volume.where(close.notna())


@pytest.fixture(scope="module")
def bars(spark, frames):
    close, volume = frames
    long = close.stack().rename("adj_close").to_frame().join(volume.stack().rename("volume")).reset_index(names=["date", "ticker"]).dropna()
    long["close"], long["open"], long["high"], long["low"] = long.adj_close, long.adj_close * 0.999, long.adj_close * 1.01, long.adj_close * 0.99
    return spark.createDataFrame(long)


@pytest.fixture(scope="module")
def fundamentals(spark):
    rng = np.random.default_rng(3)
    rows = [(d, f"T{i}", *map(float, rng.uniform(0.1, 2, 13)), f"S{i % 2}") for d in pd.date_range("2022-10-01", periods=12, freq="QS")[:6] for i in range(5)]
    from factorlake.sources.market import FUNDAMENTALS

    return spark.createDataFrame(pd.DataFrame(rows, columns=["date", "ticker", *FUNDAMENTALS, "sector"]))


def wide(df, name):
    return df.select("date", "ticker", name).toPandas().pivot(index="date", columns="ticker", values=name).sort_index()


def close_to(got, want):
    want = want.loc[got.index, got.columns]
    assert np.allclose(got.to_numpy(float), want.where(got.notna() | want.notna()).to_numpy(float), rtol=1e-7, atol=1e-9, equal_nan=True)


def test_sizes(bars, fundamentals):
    assert [len(f()[1]) for f in (families.momentum, families.volatility, families.volume, families.technical, families.value, families.quality, families.alternative)] == [59, 41, 34, 42, 48, 49, 28]
    df, names = matrix.all_features(bars, fundamentals)
    assert len(names) == len(set(names)) == 311
    assert {r.ticker for r in df.select("ticker").distinct().collect()} == {f"T{i}" for i in range(5)}
    row = df.selectExpr(*[f"count_if(abs({n}) = double('inf'))" for n in names[:50]]).first()
    assert not any(row)


def test_momentum(bars, frames):
    close, _ = frames
    df = matrix.momentum(bars)[0].cache()
    held = close.notna()
    ema = lambda s: close.ewm(span=s, adjust=False).mean()
    macd = ema(12) - ema(26)
    close_to(wide(df, "mom_20d"), (close / close.shift(20) - 1).where(held))
    close_to(wide(df, "macd_hist"), (macd - macd.ewm(span=9, adjust=False).mean()).where(held))
    close_to(wide(df, "price_ema_ratio_20"), (close / (ema(20) + 1e-8) - 1).where(held))
    close_to(wide(df, "drawdown_20d"), ((close - close.rolling(20, min_periods=10).max()) / (close.rolling(20, min_periods=10).max() + 1e-8)).where(held))
    close_to(wide(df, "mom_20d_ts_rank"), (close / close.shift(20) - 1).rank(pct=True).where(held))


def test_volatility_and_volume(bars, frames):
    close, volume = frames
    ret, held = close / close.shift(1) - 1, close.notna()
    vol = matrix.volatility(bars)[0].cache()
    market = ret.mean(axis=1)
    close_to(wide(vol, "vol_20d"), (ret.rolling(20, min_periods=10).std() * np.sqrt(252)).where(held))
    close_to(wide(vol, "skew_20d"), ret.rolling(20, min_periods=10).skew().where(held))
    close_to(wide(vol, "kurt_60d"), ret.rolling(60, min_periods=30).kurt().where(held))
    close_to(wide(vol, "var_5pct_20d"), ret.rolling(20, min_periods=10).quantile(0.05).where(held))
    beta = ret.apply(lambda c: c.rolling(60, min_periods=30).cov(market)).div(market.rolling(60, min_periods=30).var() + 1e-10, axis=0)
    close_to(wide(vol, "beta_60d"), beta.where(held))
    close_to(wide(vol, "vol_rank_20d"), (ret.rolling(20, min_periods=10).std() * np.sqrt(252)).rank(axis=1, pct=True).where(held))
    amount = matrix.volume(bars)[0].cache()
    close_to(wide(amount, "abnorm_vol_20d"), (volume / (volume.rolling(20, min_periods=10).mean() + 1e-8)).where(held))
    close_to(wide(amount, "price_vol_corr_60d"), ret.rolling(60, min_periods=30).corr(volume / volume.shift(1) - 1).where(held))


def test_technical(bars, frames):
    close, _ = frames
    held, delta = close.notna(), close.diff()
    df = matrix.technical(bars)[0].cache()
    gain, loss = delta.clip(lower=0).rolling(14, min_periods=7).mean(), (-delta.clip(upper=0)).rolling(14, min_periods=7).mean()
    close_to(wide(df, "rsi_14"), (100 - 100 / (1 + gain / (loss + 1e-8))).where(held))
    slope = close.apply(lambda c: c.rolling(20).apply(lambda y: np.polyfit(np.arange(20), y, 1)[0], raw=True)) / (close + 1e-8)
    got = wide(df, "trend_slope_20")
    assert np.allclose(got.to_numpy(float), slope.loc[got.index, got.columns].where(held.loc[got.index]).to_numpy(float), atol=1e-7, equal_nan=True)
    tp = (close * 1.01 + close * 0.99 + close) / 3
    mad = tp.rolling(14, min_periods=7).apply(lambda x: np.nanmean(np.abs(x - np.nanmean(x))), raw=True)
    close_to(wide(df, "cci_14"), ((tp - tp.rolling(14, min_periods=7).mean()) / (0.015 * mad + 1e-8)).where(held))
    close_to(wide(df, "aroon_up_14"), (close * 1.01).rolling(14).apply(lambda w: 100.0 * (14 - (13 - int(np.argmax(w)))) / 14, raw=True).where(held))


def test_asof_is_backward_and_by_column(spark):
    panel = spark.createDataFrame(pd.DataFrame({"date": pd.to_datetime(["2024-01-02", "2024-02-02", "2024-03-04"]), "ticker": "A", "adj_close": [1.0, 2.0, 3.0]}))
    reports = spark.createDataFrame(pd.DataFrame({"date": pd.to_datetime(["2024-01-15", "2024-02-15"]), "ticker": "A", "roe": [0.1, None], "roa": [0.2, 0.3]}))
    got = [(r.roe, r.roa) for r in P.asof_fundamentals(panel, reports).orderBy("date").collect()]
    assert [(None if a is None or a != a else a, b) for a, b in got] == [(None, None), (0.1, 0.2), (0.1, 0.3)] or got[2][1] == 0.3


def test_two_ways_to_the_exponential_mean(bars):
    dense = matrix.dense(bars)
    a, b = P.with_emas(dense).select("date", "ticker", "ema20"), P.ema_by_sql(dense, 20)
    assert a.join(b, ["date", "ticker"]).where("abs(ema20 - ema) > 1e-9 or (ema20 is null) <> (ema is null)").count() == 0


def test_flags_are_never_null_and_clips_keep_nulls(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double")
    got = df.selectExpr(f"{K.flag('x > 0')} AS f", f"{K.low_clip('x')} AS lo", f"{K.high_clip('x')} AS hi").collect()
    assert [tuple(r) for r in got] == [(0.0, None, None), (0.0, 0.0, -1.0), (1.0, 2.0, 0.0)]


def test_dedup_and_empty_columns(spark):
    df = spark.createDataFrame([("d", "t", 1.0, None)], "date string, ticker string, a double, b double")
    assert P.drop_empty_columns(df).columns == ["date", "ticker", "a"]
    assert [names for _, names in P.dedup_columns([(df, ["a", "b"]), (df, ["b", "c"])])] == [["a", "b"], ["c"]]
