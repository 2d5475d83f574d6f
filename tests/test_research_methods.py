"""Operators held against hand-computed values, plain numpy or MLlib."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.functions.kernels import apply_layers, roll, roll_pair
from factorlake.operators import causal, graph, models, regime, research, risk, text, vector


def panel_of(spark, values, ticker="A"):
    days = pd.date_range("2000-01-01", periods=len(values))
    return spark.createDataFrame(pd.DataFrame({"date": days, "ticker": ticker, "x": np.asarray(values, dtype=float), "y": np.arange(len(values), dtype=float)}))


def test_nothing_outside_a_window_reaches_it(spark):
    values = np.random.default_rng(1).normal(size=1000) * 1e-3
    values[100], values[300] = np.inf, 1e12
    layer = {"m": roll("avg", "x", 60), "s": roll("stddev_samp", "x", 60), "c": roll_pair("covar_samp", "y", "x", 60, 10)}
    got = apply_layers(panel_of(spark, values), [layer]).orderBy("date").toPandas()
    for at in (99, 160, 250, 360, 999):
        window = values[max(0, at - 59) : at + 1]
        assert got.m[at] == pytest.approx(window.mean(), rel=1e-9) and got.s[at] == pytest.approx(window.std(ddof=1), rel=1e-9)
        assert got.c[at] == pytest.approx(np.cov(window, np.arange(at - len(window) + 1, at + 1))[0, 1], rel=1e-6)


def test_a_long_series(spark):
    values = 1e9 + np.random.default_rng(2).normal(size=10_000)
    got = apply_layers(panel_of(spark, values), [{"s": roll("stddev_samp", "x", 252)}]).orderBy("date").toPandas()
    assert all(got.s[at] == pytest.approx(values[at - 251 : at + 1].std(ddof=1), rel=1e-6) for at in (500, 5_000, 9_999))


def test_error_of_influence_values(spark):
    f = np.random.default_rng(3).normal(1.0, 2.0, 60)
    e, n = f - f.mean(), len(f)
    h = np.minimum(1 / n + e**2 / ((e**2).sum() + 1e-9), 0.99)
    se = np.sqrt(((e / (1 - h)) ** 2).mean() / n)
    row = causal.hc3_se_pvalue(spark.createDataFrame([(float(v),) for v in f] + [(None,)], "influence double")).first()
    assert (row.ate, row.se, row.n) == (pytest.approx(f.mean()), pytest.approx(se), n) and row.p == pytest.approx(2 * (1 - 0.5 * (1 + np.vectorize(__import__("math").erf)(abs(f.mean() / se) / np.sqrt(2)))), abs=1e-6)
    assert causal.hc3_se_pvalue(spark.createDataFrame([(2.0,)], "influence double")).first().p == 1.0


def test_latent_common_cause_is_marked(spark):
    r = np.random.default_rng(4)
    hidden, a0, b0 = r.normal(size=(3, 4000))
    a, b = hidden + a0, hidden + b0
    data = np.column_stack([a, b, a + b + r.normal(size=4000)])
    df = spark.createDataFrame(pd.DataFrame(data, columns=["a", "b", "c"]))
    correlations = causal.pair_correlations(df, ["a", "b", "c"])
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "i string, j string")
    arrows = spark.createDataFrame([("a", "c"), ("b", "c")], "src string, dst string")
    assert [(x.i, x.j) for x in causal.latent_confounder_edges(edges, arrows, correlations).collect()] == [("a", "b")]
    assert causal.latent_confounder_edges(edges, arrows.where("false"), correlations.where("i <> 'c' and j <> 'c'")).count() == 0
    partial = {(x.i, x.j): x.r for x in causal.partial_given_rest(correlations).collect()}
    residual = [v - np.polyval(np.polyfit(data[:, 2], v, 1), data[:, 2]) for v in (a, b)]
    assert partial[("a", "b")] == pytest.approx(np.corrcoef(*residual)[0, 1], abs=1e-9)


def test_pieces_end_at_the_best_separator():
    assert text.split_text("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert text.split_text("one. two.\n\nthree three\nfour", 12, 0) == ["one. two.", "three three", "four"]
    assert text.split_text("x" * 30, 10, 2) == ["x" * 30] and text.split_text("  ", 10, 2) == []
    words = " ".join(f"w{i}" for i in range(500))
    pieces = text.split_text(words, 64, 16)
    assert all(len(p) <= 64 for p in pieces) and [w for i, p in enumerate(pieces) for w in p.split() if not i or w not in pieces[i - 1].split()] == words.split()


def test_least_squares_forecast(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 2))
    y = x @ [2.0, -1.0] + 0.01 * r.normal(size=40)
    rows = pd.DataFrame({"ticker": "A", "date": pd.date_range("2020-01-01", periods=40), "a": x[:, 0], "b": x[:, 1], "y": y})
    got = {g.horizon: g.forecast for g in regime.forecast_ols(spark.createDataFrame(rows), ["a", "b"], "y", [1, 4]).collect()}
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert got[1] == pytest.approx(x[-1] @ beta) and got[4] == pytest.approx(2 * x[-1] @ beta)
    assert {g.forecast for g in regime.forecast_ols(spark.createDataFrame(rows[:8]), ["a", "b"], "y", [1]).collect()} == {0.0}


def test_lasso_from_sums_equals_fits_on_rows(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 3))
    rows = pd.DataFrame(x, columns=["a", "b", "c"]).assign(date=np.repeat(pd.date_range("2020-01-01", periods=60), 5), y=x @ [1.0, 0.0, -0.5] + 0.3 * r.normal(size=300))
    df = spark.createDataFrame(rows)
    best, errors = models.lasso_cv(df, ["a", "b", "c"], "y", folds=3, purge=2, strengths=4)
    strength, mse = errors[2]
    blocks, by_hand = np.array_split(np.arange(60), 4), []
    day = np.repeat(np.arange(60), 5)
    for fold in (1, 2, 3):
        train = df.where(F.col("date").isin([rows.date[5 * d] for d in range(blocks[fold][0] - 2)]))
        kept = models.lasso_select(train, ["a", "b", "c"], "y", strength)
        part, test = rows[day < blocks[fold][0] - 2], rows[np.isin(day, blocks[fold])]
        beta = np.array([kept.get(f, 0.0) for f in "abc"])
        start = part.y.mean() - part[["a", "b", "c"]].mean().to_numpy() @ beta
        by_hand.append(((test.y - start - test[["a", "b", "c"]].to_numpy() @ beta) ** 2).mean())
    assert mse == pytest.approx(np.mean(by_hand), rel=1e-3) and best == min(errors, key=lambda e: e[1])[0]


def test_lasso_does_not_depend_on_a_shift(spark):
    r = np.random.default_rng(16)
    x = r.normal(size=(400, 2))
    rows = pd.DataFrame(x, columns=["a", "b"]).assign(date=np.repeat(pd.date_range("2020-01-01", periods=80), 5), y=x @ [0.7, -0.4] + 0.1 * r.normal(size=400))
    plain, shifted = (models.lasso_cv(spark.createDataFrame(t), ["a", "b"], "y", folds=4) for t in (rows, rows.assign(a=rows.a + 1e8, y=rows.y - 1e6)))
    assert plain[0] == shifted[0]
    assert [e for _, e in shifted[1]] == pytest.approx([e for _, e in plain[1]], rel=1e-6)


def test_importance_by_tree_finds_the_feature(spark):
    x = np.random.default_rng(7).normal(size=(400, 2))
    rows = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": 3 * x[:, 0]})
    made = models.mda_importance(spark.createDataFrame(pd.concat([rows, rows])), ["a", "b"], "y", trees=5)
    assert made["a"] > 10 * abs(made["b"])


def test_update_of_many_views_equals_the_matrix_form(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(50, 4)) * 0.02
    names = list("abcd")
    rows = [("u", t, int(d), float(x[d, k])) for d in range(50) for k, t in enumerate(names)]
    p, q, omega = np.array([[1.0, -1, 0, 0], [0, 0.5, 0.5, -1]]), np.array([0.01, -0.02]), np.array([0.02, 0.01])
    views = [("u", f"v{i}", t, float(p[i, k])) for i in range(2) for k, t in enumerate(names) if p[i, k]]
    got = risk.bl_update(spark.createDataFrame(rows, "universe string, ticker string, date int, r double"), spark.createDataFrame(views, "universe string, view string, ticker string, p double"), spark.createDataFrame([("u", f"v{i}", float(q[i]), float(omega[i])) for i in range(2)], "universe string, view string, q double, omega double"))
    sigma, pi = np.cov(x.T), x.mean(axis=0)
    prior = np.linalg.inv(0.05 * sigma)
    mu = np.linalg.solve(prior + p.T @ np.diag(1 / omega) @ p, prior @ pi + p.T @ np.diag(1 / omega) @ q)
    assert {g.ticker: pytest.approx(g.mu) for g in got.collect()} == dict(zip(names, mu, strict=True))


def test_correlations_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    r = np.random.default_rng(9)
    wide = pd.DataFrame(r.normal(size=(40, 15)), columns=[f"t{i}" for i in range(15)], index=pd.date_range("2020-01-01", periods=40))
    wide.iloc[:25, 3], wide.iloc[20:, 4], wide["t5"] = np.nan, np.nan, 7.0
    rows = wide.rename_axis("date").reset_index().melt("date", var_name="ticker", value_name="returns").dropna()
    got = {(g.src, g.dst): g.corr for g in graph.ticker_correlations(spark.createDataFrame(rows)).collect()}
    want = wide.corr(min_periods=2).fillna(0.0)
    assert all(value == pytest.approx(want.loc[a, b], abs=1e-9) and a < b for (a, b), value in got.items()) and len(got) == 15 * 14 // 2 - 1 + (("t3", "t4") in got)


def test_moments_of_pairs_with_nulls(spark):
    r = np.random.default_rng(10)
    rows = pd.DataFrame(r.normal(size=(200, 3)) + 1e6, columns=["a", "b", "c"])
    rows.loc[:50, "b"] = np.nan
    df = spark.createDataFrame(rows).replace(float("nan"), None)
    want = rows.cov()
    assert all(x["cov"] == pytest.approx(want.loc[x.a, x.b], rel=1e-6) for x in research.cov_matrix(df, ["a", "b", "c"]).collect())
    assert all(x.r == pytest.approx(rows.corr().loc[x.a, x.b], rel=1e-6) for x in research.corr_matrix(df, ["a", "b", "c"]).collect())


def test_approximate_neighbours_reach_recall(spark):
    r = np.random.default_rng(11)
    centres = r.normal(size=(40, 16)) * 3
    rows = [(i, [float(v) for v in centres[i % 40] + r.normal(size=16) * 0.3]) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    exact = {(x.query_id, x.vec_id) for x in vector.knn_l2(queries, vectors, 5).collect()}
    near = {(x.query_id, x.vec_id) for x in vector.knn_lsh(queries, vectors, 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_a_query_is_not_its_own_duplicate(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.01]), (1, [0.0, 1.0]), (100, [-1.0, 0.0])], "vec_id long, v array<double>")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    assert {x.query_id: x.duplicate for x in vector.near_duplicate(queries, vectors).collect()} == {0: True, 50: True, 100: False}
