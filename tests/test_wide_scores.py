"""Scores of wide parts, and composites from the columns they need."""

import numpy as np
import pandas as pd

from factorlake.functions.kernels import pruned, roll
from factorlake.operators import research as R
from factorlake.plans import features as families


def test_wide_series_equal_those_of_long_rows(spark):
    r = np.random.default_rng(1)
    names = [f"f{i}" for i in range(R.BLOCK + 3)]  # two blocks
    rows = []
    for day in pd.date_range("2020-01-01", periods=4):
        for ticker in range(9):
            values = [None if r.random() < 0.2 else float("nan") if r.random() < 0.05 else float(np.round(r.standard_normal(), 1)) for _ in names]
            rows.append((day.to_pydatetime(), str(ticker), None if r.random() < 0.2 else float(np.round(r.standard_normal(), 1)), *values))
    df = spark.createDataFrame(rows, "date timestamp, ticker string, fwd double, " + ", ".join(f"{n} double" for n in names))
    long = df.unpivot(["date", "ticker"], names, "feature", "value")
    want = {(x.feature, x.date): x.ic for x in R.ic_series(long, df.select("date", "ticker", "fwd").where("fwd is not null")).collect()}
    made = R.wide_ic_series([(df.drop("ticker", *names[3:]), names[:3]), (df.drop("ticker", *names[:3]), names[3:])]).collect()
    got = {(x.feature, x.date): x.ic for x in made if x.pairs}
    assert got.keys() == want.keys()
    assert all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-12) for k, a in got.items())
    held = df.toPandas()[names].notna().sum()
    nulls = {n: sum(x.held for x in made if x.feature == n) for n in names}
    assert all(nulls[n] == sum(v is not None for v in (row[3 + i] for row in rows)) for i, n in enumerate(names)) and held.sum() <= sum(nulls.values())
    assert {x.rows for x in made} == {9}


def test_pruned_layers_keep_what_a_column_needs():
    layers = [{"a": roll("avg", "x", 3), "b": "x + 1"}, {"c": "a * 2", "d": roll("sum", "b", 4)}]
    assert [set(layer) for layer in pruned(layers, ["c"])] == [{"a"}, {"c"}]
    assert [set(layer) for layer in pruned(layers, ["d"])] == [{"b"}, {"d"}]
    assert "macd_hist" not in {n for layer in pruned(families.momentum()[0], ["mom_12_1"]) for n in layer}


def test_codes_of_six_digits_rank_as_the_numbers_do(spark):
    """Codes are ordered, and equal, as the six digits are, from 1e-12 to the largest doubles; scores of codes equal those of the numbers, and 32 bits a value are sent."""
    from factorlake.functions.scalar import of_six_digit_codes, six_digit_codes, six_digits_of, with_six_digit_codes, with_six_digits

    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, 20000) * 10.0 ** r.integers(-14, 300, 20000), [0.0, -0.0, 1e-12, 9e-13, 1e300, np.inf, -np.inf, 999999.4, 999999.6, 99999.95], 10.0 ** np.arange(-12.0, 300.0)])
    numbers, codes = six_digits_of(x), six_digit_codes(x).astype(np.int64)
    order = np.argsort(numbers, kind="stable")
    assert (np.sign(np.diff(codes[order])) == (np.diff(numbers[order]) > 0)).all()
    assert six_digit_codes(np.array([np.nan]))[0] > codes.max()
    assert (of_six_digit_codes(codes.astype(float)) == numbers).all()
    rows = [(d, float(r.normal()), *(None if r.random() < 0.1 else float(r.choice([1.0, 1.0000001, r.normal(), float("nan")])) for _ in range(3))) for d in range(5) for _ in range(30)]
    df = spark.createDataFrame(rows, "date int, fwd double, a double, b double, c double")
    names = ["a", "b", "c"]
    got, want = (sorted(map(tuple, R.wide_ic_series([(made(df, names), names)]).collect())) for made in (with_six_digit_codes, with_six_digits))
    assert got == want and len(got) == 15
