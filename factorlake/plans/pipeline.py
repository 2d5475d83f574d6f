"""The factor pipeline: scan, features, labels, scores, validation, ranking, sinks, as one chain of DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.operators import panel, research
from factorlake.plans import matrix
from factorlake.sources import market, sinks


def score_matrix(features: DataFrame, names: list[str], bars: DataFrame, horizon: int = 21, min_obs: int = 3) -> DataFrame:
    """(feature, ic, icir) of every named feature in one grouped job over blocks of columns; features without a score, or without a column, get 0."""
    forward = research.forward_returns(matrix.dense(bars), horizon)
    held = [n for n in names if n in features.columns]
    series = [research.wide_ic_series([(features.select("date", "ticker", *held).join(forward, ["date", "ticker"]), held)], min_obs)] if held else []
    every = features.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    return research.ic_icir(series[0], every) if held else every.select("feature", F.lit(0.0).alias("ic"), F.lit(0.0).alias("icir"))


def run(spark: SparkSession, ohlcv: str, fundamentals: str | None, out: str, horizon: int = 21, top: int = 50, **limits) -> DataFrame:
    """The ranking report; writes features, validated features and scores under ``out``.

    The matrix is written once and read again, so scoring and validation scan columns instead of computing the windows twice; columns
    without any value go then.
    """
    bars = market.scan_ohlcv(spark, ohlcv).drop("returns")
    reports = market.scan_fundamentals(spark, fundamentals) if fundamentals else None
    features, names = matrix.all_features(bars, reports)
    sinks.sink_features(features, f"{out}/features")
    features = panel.drop_empty_columns(spark.read.parquet(f"{out}/features"))
    scores = score_matrix(features, names, bars, horizon).persist()
    kept = research.validate_features(features, scores, [n for n in names if n in features.columns], **limits)
    sinks.sink_features(kept.drop("month"), f"{out}/validated")
    sinks.sink_scores_json(research.rank_signals(scores), f"{out}/scores")
    report = research.ranking_report(scores, top)
    return report
