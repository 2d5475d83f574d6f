"""Scores and correlations from stored daily states equal those of the whole matrix, for all dates and for windows."""

import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import daily_states as D
from factorlake.operators import research

FEATURES = ["a", "b", "c", "none"]


@pytest.fixture(scope="module")
def matrix(spark):
    r = np.random.default_rng(1)
    rows = []
    for day in range(30):
        for t in range(25):
            a = r.normal(day, 1) + 1e6
            rows.append((datetime(2024, 1, 1) + timedelta(days=day), f"t{t}", a, None if r.random() < 0.3 else float(-a + r.normal()), float(r.integers(0, 2)), None, float(r.normal())))
    return spark.createDataFrame(rows, "date timestamp, ticker string, a double, b double, c double, none double, fwd double").cache()


def table(df):
    return {(x.a, x.b): x.r for x in df.collect()}


def close(one, two):
    assert one.keys() == two.keys()
    for k in one:
        assert (one[k] is None) == (two[k] is None) and (one[k] is None or abs(one[k] - two[k]) < 1e-9), k


def test_correlations_equal_the_whole_matrix(spark, matrix, tmp_path):
    states = D.DailyStates(spark, str(tmp_path / "pairs"), D.PAIRS)
    early, last = matrix.where("date < '2024-01-30'"), matrix.where("date >= '2024-01-30'")
    states.add(D.pair_states(early, FEATURES))
    files = {f: os.path.getmtime(f) for d, _, names in os.walk(states.path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}
    close(table(D.correlations(states.between(), FEATURES)), table(research.corr_matrix(early, FEATURES)))
    states.add(D.pair_states(last, FEATURES))
    assert all(os.path.getmtime(f) == t for f, t in files.items())
    close(table(D.correlations(states.between(), FEATURES)), table(research.corr_matrix(matrix, FEATURES)))
    window = matrix.where("date between '2024-01-05' and '2024-01-12'")
    close(table(D.correlations(states.between("2024-01-05", "2024-01-12"), FEATURES)), table(research.corr_matrix(window, FEATURES)))
    states.add(D.pair_states(last, FEATURES))  # once more: replaced, not doubled
    close(table(D.correlations(states.between(), FEATURES)), table(research.corr_matrix(matrix, FEATURES)))


def test_scores_equal_the_whole_series(spark, matrix, tmp_path):
    long = matrix.unpivot(["date", "ticker"], ["a", "b", "c"], "feature", "value")
    forward = matrix.select("date", "ticker", "fwd")
    states = D.DailyStates(spark, str(tmp_path / "scores"), D.SCORES)
    for first in (True, False):
        part = F.col("date") < F.lit("2024-01-20") if first else F.col("date") >= F.lit("2024-01-20")
        states.add(D.ic_states(long.where(part), forward.where(part)))
    key = lambda df: {x.feature: (round(x.ic, 10), round(x.icir, 10)) for x in df.collect()}
    assert key(research.ic_icir(states.between())) == key(research.ic_icir(research.ic_series(long, forward)))
    late = long.where("date >= '2024-01-25'")
    assert key(research.ic_icir(states.between("2024-01-25"))) == key(research.ic_icir(research.ic_series(late, forward)))


def test_empty(spark):
    none = spark.createDataFrame([], "date timestamp, ticker string, a double, b double, c double, none double")
    assert D.correlations(D.pair_states(none, FEATURES), FEATURES).count() == 0
