"""Series windows computed by blocks of tickers equal plain SQL frames: gaps, infinities, tickers of unlike length; a family's windows stay in one stage."""

import numpy as np
import pandas as pd

from factorlake.functions import kernels as K
from factorlake.functions import series
from factorlake.plans import features as families


def panel_of(spark, lengths=(70, 3, 41, 300)):
    r = np.random.default_rng(5)
    none = lambda v: None if r.random() < 0.2 else float(v)
    rows = [(f"t{t}", i, none(np.inf if i == 20 else r.normal(2, 1)), none(r.normal(0, 3))) for t, n in enumerate(lengths) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date int, x double, y double")


def test_equals_plain_frames(spark):
    ops, plain = {}, {}
    for n, least in ((5, 2), (20, 10), (60, 30), (252, 63)):
        for agg in ("sum", "avg", "max", "min", "var_samp", "stddev_samp"):
            ops[f"{agg}{n}"] = (agg, ("x",), (n, least))
            plain[f"{agg}{n}"] = f"CASE WHEN count(x) {K.frame(n)} >= {least} THEN {agg}(x) {K.frame(n)} END"
        for agg in ("covar_samp", "regr_slope"):
            ops[f"{agg}{n}"] = (agg, ("y", "x"), (n, least))
            plain[f"{agg}{n}"] = f"CASE WHEN count(CASE WHEN y IS NOT NULL THEN x END) {K.frame(n)} >= {least} THEN {agg}(y, x) {K.frame(n)} END"
        ops[f"q{n}"], plain[f"q{n}"] = ("quantile", ("y",), (0.3, n, least)), f"CASE WHEN count(y) {K.frame(n)} >= {least} THEN percentile(y, 0.3D) {K.frame(n)} END"
    others = {"lag": K.lag("y", 7), "lead": K.lead("y", 2), "filled": K.fill_forward("y", 2), "run": K.running("sum", "y"), "own": K.own_rank("x"), "pos": K.position()}
    ops |= {name: K._series[sql] for name, sql in others.items()}
    rows = series.add(panel_of(spark), ops).selectExpr("*", *[f"{sql} AS want_{name}" for name, sql in {**plain, **others}.items()]).toPandas()
    assert len(rows) == 414
    for name in ops:
        a, b = rows[name].to_numpy(float), rows[f"want_{name}"].to_numpy(float)
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True), name


def test_families_need_one_sort_by_ticker(spark):
    panel = panel_of(spark).selectExpr("ticker", "date", "x AS adj_close", "x AS close", "y AS volume", "y AS returns", "x AS high", "x AS low")
    for family in (families.volume, families.technical, families.base_factory):
        layers, names = family()
        last = [i for i, layer in enumerate(layers) if not any("PARTITION BY date" in sql for sql in layer.values())][-1]
        plan = K.apply_layers(panel, layers[: last + 1])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1, family.__name__


def test_digest_deals_only_what_ranks_need(spark):
    """The digest of a family equals that of its matrix, and no value of a series column is shuffled a second time."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from factorlake.plans import matrix

    r = np.random.default_rng(8)
    rows = [(datetime(2024, 1, 1) + timedelta(days=d), f"t{t}", *map(float, r.uniform(5, 9, 4)), float(r.integers(1, 99))) for t in range(6) for d in range(90) if (d + t) % 9]
    bars = spark.createDataFrame(rows, "date timestamp, ticker string, open double, high double, low double, close double, volume double").withColumn("adj_close", F.col("close"))
    for plan in (matrix.volume_plan(bars), matrix.volatility_plan(bars), matrix.base_factory_plan(bars)):
        made, (whole, names) = matrix.family_digest(*plan), matrix.priced(*plan)
        key = lambda df: sorted(map(tuple, df.select("feature", "ticker", "n", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "mean")]).collect()))
        assert len(key(made)) > 100 and key(made) == key(matrix.digest(whole, names))
        assert "Expand" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_exponential_mean_skips_missing_values(spark):
    values = [None, 2.0, float("nan"), 3.0, None, 5.0]
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "ticker string, date int, x double")
    got = [r.e for r in series.add(df, {"e": ("ewm", ("x",), (3,))}).orderBy("date").collect()]
    assert got[0] is None and np.allclose(got[1:], pd.Series(values, dtype=float).ewm(span=3, adjust=False).mean()[1:])


def test_windows_of_the_same_values_have_the_same_deviation():
    """A median of deviations is met by one that is equal to it: where one null leaves a window as another enters, no bit may change."""
    r = np.random.default_rng(3)
    held = r.random((40, 300)) > 0.2
    block = series.Block({"x": (np.where(held, r.normal(0, 0.03, held.shape), 0.0), held)}, held.shape, [])
    for n in (5, 20, 60):
        values, valid = block.of_stddev_samp("x", n, n // 2)
        same = ~held[:, n:] & ~held[:, :-n] & valid[:, n:]
        assert same.sum() > 100 and (values[:, n:][same] == values[:, n - 1 : -1][same]).all()
