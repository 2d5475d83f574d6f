"""Golden cases: scores, ranking, validation, costs, as-of reads, streams, texts, retrieval, keyed tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.operators import causal, models, regime, research, risk, tables, text, vector
from factorlake.sources import market, sinks
from factorlake.streaming import ticks


def panel_rows(n_dates, n_tickers, value):
    days = pd.bdate_range("2024-01-01", periods=n_dates)
    rng = np.random.default_rng(11)
    return [(d, f"T{t}", "f", value(rng, i, t), float(rng.normal())) for i, d in enumerate(days) for t in range(n_tickers)]


def scored(spark, rows, min_obs=3):
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "ticker", "feature", "value", "fwd"]))
    return research.ic_icir(research.ic_series(df.select("date", "ticker", "feature", "value"), df.select("date", "ticker", "fwd"), min_obs), df).first()


def test_constant_feature_and_few_observations(spark):
    row = scored(spark, panel_rows(30, 10, lambda *_: 1.0))
    assert row.ic == 0.0 and row.icir == 0.0
    assert scored(spark, panel_rows(5, 3, lambda rng, *_: float(rng.normal())), min_obs=10).ic == 0.0


def test_ic_is_spearman(spark):
    rows = panel_rows(20, 15, lambda rng, i, t: float(rng.integers(0, 5)))
    df = pd.DataFrame(rows, columns=["date", "ticker", "feature", "value", "fwd"])
    want = df.groupby("date").apply(lambda g: g.value.rank().corr(g.fwd.rank()), include_groups=False)
    row = scored(spark, rows)
    assert abs(row.ic - want.mean()) < 1e-12 and abs(row.icir - want.mean() / want.std()) < 1e-12


def test_forward_return_tail(spark):
    panel = market.with_returns(market.synthetic_panel(spark, 3, 60).withColumn("date", F.col("date")))
    assert research.forward_returns(panel, 21).groupBy("ticker").count().where("count <> 39").count() == 0


def test_validation_and_ranking(spark):
    scores = spark.createDataFrame([("strong", 0.08, 1.2), ("weak", 0.005, 0.1), ("noisy", 0.03, 0.8)], "feature string, ic double, icir double")
    nulls = spark.createDataFrame([("strong", 0.0), ("weak", 0.0), ("noisy", 0.5)], "feature string, null_fraction double")
    summary = research.validation_summary(scores, nulls).collect()
    assert [r.feature for r in summary] == ["strong", "noisy", "weak"] and [r.feature for r in summary if r.passed] == ["strong"]
    ranked = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.1, -2.0), ("c", 0.1, 0.2)], "feature string, ic double, icir double")
    report = research.ranking_report(ranked).collect()
    assert [r.signal_name for r in report] == ["b", "a", "c"] and [r["rank"] for r in report] == [1, 2, 3]


def test_orthogonalise_leaves_no_projection(spark):
    rng = np.random.default_rng(1)
    f = rng.normal(size=(200, 2))
    s = f @ [2.0, -1.0] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"s": s, "f1": f[:, 0], "f2": f[:, 1]}))
    row = research.orthogonalise(df, "s", ["f1", "f2"]).agg(F.sum(F.col("residual") * F.col("f1")), F.sum(F.col("residual") * F.col("f2")), F.max("residual_ratio")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1]) < 1e-9 and 0 < row[2] < 0.1


def test_half_life_of_a_decay(spark):
    rng, x, rows = np.random.default_rng(2), 0.0, []
    for i, d in enumerate(pd.bdate_range("2000-01-03", periods=4000)):
        x = 0.9 * x + rng.normal()
        rows.append(("f", "T", d, x))
    got = research.half_life(spark.createDataFrame(pd.DataFrame(rows, columns=["feature", "ticker", "date", "value"]))).first().half_life
    assert 4 < got < 10


def test_cost_model(spark):
    cost = risk.transaction_cost(F.lit(10_000.0), F.lit(1_000_000.0), F.lit(0.02), F.lit(100.0))
    zero = risk.transaction_cost(F.lit(0.0), F.lit(1.0), F.lit(0.02), F.lit(100.0))
    assert spark.range(1).select(cost, zero).first()[:] == (pytest.approx(3000.0), 0.0)


def test_cvar_two_ways(spark):
    rng = np.random.default_rng(5)
    pnl = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(rng.normal(size=400))], "portfolio string, date int, pnl double")
    losses = np.sort(-rng.__class__(np.random.PCG64(5)).normal(size=400))[::-1]
    got = risk.ru_cvar(pnl).first().cvar
    assert got == pytest.approx(min(g + np.maximum(losses - g, 0).sum() / (0.05 * 400) for g in losses), rel=1e-9)


def test_attribution_adds_up(spark):
    p = spark.createDataFrame([("a", 0.6, 0.1), ("b", 0.4, 0.0)], "segment string, weight double, r double")
    b = spark.createDataFrame([("a", 0.5, 0.05), ("c", 0.5, 0.02)], "segment string, weight double, r double")
    total = {r.segment: r for r in risk.brinson_attribution(p, b).collect()}["TOTAL"]
    assert total.total == pytest.approx(0.06 - 0.035)


def test_black_litterman_without_views_moves_to_the_view(spark):
    row = ("u", ["A", "B"], [0.05, 0.03], [[0.04, 0.01], [0.01, 0.09]], [[1.0, -1.0]], [0.1], [1e-9])
    df = spark.createDataFrame([row], "universe string, tickers array<string>, pi array<double>, sigma array<array<double>>, p array<array<double>>, q array<double>, omega array<double>")
    mu = {r.ticker: r.mu for r in risk.bl_posterior(df).collect()}
    assert mu["A"] - mu["B"] == pytest.approx(0.1, abs=1e-4)


def test_skeleton_and_collider(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 3000))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": x + y + 0.3 * rng.normal(size=3000)}))
    edges, sepsets = causal.ci_skeleton(df, ["x", "y", "z"])
    assert {(r.i, r.j) for r in edges.collect()} == {("x", "z"), ("y", "z")}
    assert {(r.src, r.dst) for r in causal.orient_colliders(edges, sepsets).collect()} == {("x", "z"), ("y", "z")}


def test_linear_effect(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=2000)
    t = x + rng.normal(size=2000)
    df = spark.createDataFrame(pd.DataFrame({"id": range(2000), "x": x, "t": t, "y": 0.5 * t + 2 * x + rng.normal(size=2000)}))
    row = causal.dml_linear(df, "x", "t", "y").first()
    assert abs(row.ate - 0.5) < 0.08 and row.p < 1e-6


def test_bars_as_of(spark):
    at = lambda m: dt.datetime(2025, 6, 1, 10, m)
    bars = spark.createDataFrame([("MSFT", at(0), 300.5), ("MSFT", at(5), 302.5), ("MSFT", at(10), 304.0)], "symbol string, timestamp timestamp, close double")
    cut = spark.createDataFrame([("MSFT", at(5))], "symbol string, cutoff timestamp")
    assert [r.close for r in tables.bars_as_of_k(bars, cut, 5).collect()] == [300.5, 302.5]
    assert tables.latest_bar_as_of(bars, cut).first().close == 302.5


def test_upsert_update_delete(spark):
    base = spark.createDataFrame([("h1", 0.75, "x"), ("h2", 0.5, None)], "id string, confidence double, note string")
    new = spark.createDataFrame([("h1", 0.8, "a", 1), ("h1", 0.9, "b", 2), ("h3", 0.1, "c", 1)], "id string, confidence double, note string, v int")
    assert {r.id: r.confidence for r in tables.upsert_by_key(base, new, ["id"], "v").collect()} == {"h1": 0.9, "h2": 0.5, "h3": 0.1}
    assert {r.id: r.confidence for r in tables.update_by_key(base, spark.createDataFrame([("h1", 0.8)], "id string, confidence double"), ["id"]).collect()} == {"h1": 0.8, "h2": 0.5}
    assert [r.id for r in tables.delete_by_key(base, base.where("id = 'h1'"), ["id"]).collect()] == ["h2"]


def test_tick_stream(spark, tmp_path):
    rows = ['{"symbol":"AAPL","timestamp":"2026-06-19T10:00:00Z","close":151.0}', '{"symbol":"AAPL","timestamp":"2026-06-19T10:00:00Z","close":152.0}', '{"symbol":"","timestamp":1}', "not json", '{"symbol":"MSFT","timestamp":1781863200.5}']
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        ticks.sink_ticks(ticks.tick_parse(ticks.tick_stream_read(spark, f"{tmp_path}/in")), f"{tmp_path}/t", f"{tmp_path}/c", f"{tmp_path}/dead").awaitTermination()
    got = {r.symbol: r for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert len(got) == 2 and got["AAPL"].timestamp == dt.datetime(2026, 6, 19, 10) and got["MSFT"].close == 0.0
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 2
    stream = ticks.tick_upsert(ticks.tick_parse(ticks.tick_stream_read(spark, f"{tmp_path}/in")))
    query = stream.writeStream.format("memory").queryName("landed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("landed").count() == 2


def test_text(spark):
    df = spark.createDataFrame([(1, "Title line\nAbstract: We  test.\n\nIntro- \nducing 1987 words\n\n\n\nReferences\nX 2001")], "id int, text string")
    row = df.select(text.clean_text(F.col("text")).alias("c"), text.paper_metadata(F.col("text")).alias("m"), text.strip_references(F.col("text")).alias("s")).first()
    assert "\n\n\n" not in row.c and row.m.title == "Title line" and row.m.year == 1987 and row.m.abstract == "We  test." and "2001" not in row.s
    pieces = text.chunk_fixed(spark.createDataFrame([("f", "word" * 500)], "f string, t string"), "f", "t").orderBy("chunk_index").collect()
    assert [p.chunk_id for p in pieces][:2] == ["f_chunk_0000", "f_chunk_0001"] and pieces[0].text[-64:] == pieces[1].text[:64]
    assert len(text.chunk_paragraph(df, "id", "text").collect()) == 3


def test_facts(spark):
    good = '[{"signal_name":"mom","ic_reported":0.05,"year":1993}]'
    rows = [("c1", good), ("c2", f"```json\n{good}\n```"), ("c3", "no facts"), ("c4", "[{broken")]
    got = text.facts_parse(spark.createDataFrame(rows, "chunk_id string, response string")).collect()
    assert sorted(r.source_chunk_id for r in got) == ["c1", "c2"] and got[0].ic_reported == 0.05


def test_retrieval_measures(spark):
    ranked = spark.createDataFrame([("q", i, i + 1) for i in range(10)], "query_id string, vec_id int, rank int")
    relevant = spark.createDataFrame([("q", 1), ("q", 5)], "query_id string, vec_id int")
    row = vector.precision_recall_mrr(ranked, relevant, 2).first()
    assert (row.precision, row.recall, row.rr) == (0.5, 0.5, 0.5)


def test_cusum_and_regimes(spark):
    days = pd.bdate_range("2024-01-01", periods=60)
    jump = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": days, "value": [0.0] * 30 + [1.0] * 30}))
    assert regime.cusum(jump).count() > 0 and regime.cusum(jump.withColumn("value", F.lit(1.0))).count() == 0
    calm = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": days, "returns": [0.001, 0.0012] * 30}))
    assert {r.regime for r in regime.regime_rule(calm).collect()} == {"bull"}


def test_permutation_is_a_permutation(spark):
    rows = spark.range(200).select(F.col("id").alias("_id"), (F.col("id") * 2).alias("x"), F.col("id").alias("y"))
    made = models.permuted(rows, "x", 3).collect()
    assert sorted(r.x for r in made) == [2 * i for i in range(200)] and sum(r.x == 2 * r.y for r in made) < 20


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Date, Close ,VOLUME\n2024-01-02,1.5,10\n2024-01-03,2.5,NaN\n")
    got = market.scan_any_market_file(spark, f"{tmp_path}/m.csv").orderBy("date").collect()
    assert [r.ticker for r in got] == ["CUSTOM"] * 2 and got[1].close == 2.5 and got[1].volume is None
    landed = market.land_market_file(spark, f"{tmp_path}/m.csv", f"{tmp_path}/landed", "XYZ")
    assert dict(landed.dtypes)["close"] == "double" and sorted((r.ticker, r.close) for r in landed.collect()) == [("XYZ", 1.5), ("XYZ", 2.5)]
    panel = market.synthetic_panel(spark, 3, 40)
    sinks.sink_features(panel, f"{tmp_path}/out")
    assert market.scan_ohlcv(spark, f"{tmp_path}/out").count() == 120
    one = sinks.matrix_to_columns(panel, ["close"]).first()
    assert len(one.dates) == len(one.close) == 40 and one.dates == sorted(one.dates)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/b.txt").write_text("p1\fp2")
    (tmp_path / "d/a.txt").write_text("x")
    assert [(r.filename, r.num_pages) for r in market.scan_documents(spark, f"{tmp_path}/d").collect()] == [("a.txt", 1), ("b.txt", 2)]
