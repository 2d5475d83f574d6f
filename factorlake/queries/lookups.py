"""Queries of lookups, filters, page reads, file round trips and the rest of the model operators."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.staging import shared_folder
from factorlake.operators import models, regime, tables
from factorlake.operators import panel as P
from factorlake.plans import matrix
from factorlake.sources import derived, market, sinks

from .base import BARS, GRID, Registry, six
from .features import EMAS
from .finance import _ALL, _ENDS, forecasts
from .research import FEATURES, SMALL, shown, small

registry = Registry()


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


@registry.add("SELECT ts AS timestamp, value FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def filter_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime as dt

    rows = derived.ticks(spark, sf_dir).select("timestamp", F.col("symbol"), F.col("price").alias("value"))
    return tables.filter_as_of(rows, "7", dt.datetime(2024, 1, 20)).select("timestamp", "value")


@registry.add(f"WITH {SMALL}, g AS (SELECT ticker, count(*) AS n FROM small WHERE ret20 IS NOT NULL AND fwd IS NOT NULL GROUP BY 1) SELECT ticker, n FROM g WHERE n > 100")
def filter_finite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.filter_finite_pairs(small(spark, sf_dir), "ret20", "fwd", ["ticker"], 100).groupBy("ticker").agg(F.count("*").alias("n"))


@registry.add("SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def fk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return tables.fk_lookup(lines, derived.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@registry.add("SELECT event_id AS version_id FROM events WHERE user_id = 7 AND event_id < 900 ORDER BY event_id DESC LIMIT 3")
def list_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("thread_id"), F.col("event_id").alias("version_id"))
    return tables.list_before(rows, "7", 900, 3).select("version_id")


@registry.add("SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def episodes_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "conversations").select(F.col("role").alias("agent_name"), "conv_id", "turn", F.col("turn").alias("timestamp"), F.col("conv_id").alias("log_id"))
    return tables.episodes_by_agent(rows, "user").select("conv_id", "turn")


@registry.add("SELECT event_id, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND user_id = 3")
def facts_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "events")
    first = rows.agg(F.min("event_type")).first()[0]
    facts = rows.select(F.col("event_type").alias("agent_name"), F.col("user_id").cast("string").alias("memory_key"), "event_id", "value")
    return tables.facts_by_agent(facts, first, "3").select("event_id", "value")


@registry.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 5")
def get_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.get_by_key(derived.table(spark, sf_dir, "orders"), o_orderstatus="F", o_custkey=5).select("o_orderkey", "o_totalprice")


@registry.add("SELECT event_id FROM events WHERE (event_id % 13) / 10.0 BETWEEN 0 AND 1 AND event_id % 4 <> 3")
def valid_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "events")
    way = F.element_at(F.array(*[F.lit(x) for x in ("positive", "NEGATIVE", "neutral", "sideways")]), (F.col("event_id") % 4 + 1).cast("int"))
    return tables.valid_hypotheses(rows.select("event_id", way.alias("predicted_direction"), ((F.col("event_id") % 13) / 10).alias("confidence"))).select("event_id")


@registry.add(f"WITH RECURSIVE {BARS}, {GRID}, {EMAS} SELECT ticker, {six('sum(ema20)', 'total')}, {six('sum(macd_signal)', 'signal')} FROM with_emas WHERE adj_close IS NOT NULL GROUP BY 1")
def with_emas(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.with_emas(matrix.dense(derived.bars(spark, sf_dir))).where("adj_close is not null")
    return shown(made.groupBy("ticker").agg(F.sum("ema20").alias("total"), F.sum("macd_signal").alias("signal")), "total", "signal")


@registry.add(f"WITH RECURSIVE {BARS}, {GRID}, {EMAS} SELECT ticker, {six('sum(ema20)', 'total')} FROM with_emas WHERE adj_close IS NOT NULL GROUP BY 1")
def ema_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = matrix.dense(derived.bars(spark, sf_dir))
    made = P.ema_by_sql(dense, 20).join(dense.where("adj_close is not null").select("date", "ticker"), ["date", "ticker"])
    return shown(made.groupBy("ticker").agg(F.sum("ema").alias("total")), "total")


@registry.add(f"WITH {BARS} SELECT ticker, count(*) AS n, {six('sum(adj_close)', 'total')} FROM bars GROUP BY 1")
def scan_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written by month and read back as a typed panel."""
    path = folder(spark, "bars")
    sinks.sink_features(derived.bars(spark, sf_dir), path)
    made = market.scan_ohlcv(spark, path).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("adj_close").alias("total"))
    return shown(made, "total")


@registry.add(f"WITH {BARS} SELECT ticker, list(strftime(date, '%Y-%m-%d') ORDER BY date)[1] AS first, len(list(close)) AS n FROM bars GROUP BY 1")
def matrix_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.matrix_to_columns(derived.bars(spark, sf_dir), ["close"])
    return made.select("ticker", F.col("dates")[0].alias("first"), F.size("close").cast("long").alias("n"))


@registry.add(f"WITH {BARS} SELECT true AS subset, count(DISTINCT ticker) AS n FROM bars")
def subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = derived.bars(spark, sf_dir)
    return panel.agg(F.countDistinct("ticker").alias("n")).withColumn("subset", F.lit(P.subset_check(small(spark, sf_dir), panel)))


@registry.add(f"WITH {SMALL}, i AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, fwd)) AS importance FROM small WHERE fwd IS NOT NULL" for f in FEATURES) + f") SELECT * FROM (SELECT feature, {six('importance', 'importance')} FROM i) ORDER BY importance DESC, feature LIMIT 2")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shown(models.linear_importance(small(spark, sf_dir), FEATURES, "fwd"), "importance")
    return models.top_features(made, 2)


@registry.add(f"""WITH {_ENDS}, r AS (SELECT * FROM (VALUES ('bull', 'drift', 0.5), ('bull', 'ar1', 0.3), ('bull', 'ols', 0.2), ('high_vol', 'drift', 0.1), ('high_vol', 'ar1', 0.2), ('high_vol', 'ols', 0.7)) v(regime, model, weight)),
  f AS ({_ALL}), rule AS (SELECT ticker, CASE WHEN CAST(ticker AS INT) % 2 = 0 THEN 'bull' ELSE 'high_vol' END AS regime FROM (SELECT DISTINCT ticker FROM small))
  SELECT ticker, horizon, {six('sum(forecast * weight)', 'forecast')} FROM f JOIN rule USING (ticker) JOIN r USING (regime, model) GROUP BY 1, 2""")
def ensemble_by_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = regime.regime_weights(spark, {"bull": {"drift": 0.5, "ar1": 0.3, "ols": 0.2}, "high_vol": {"drift": 0.1, "ar1": 0.2, "ols": 0.7}})
    made = forecasts(spark, sf_dir).withColumn("regime", F.when(F.col("ticker").cast("int") % 2 == 0, "bull").otherwise("high_vol"))
    return shown(regime.ensemble_combine(made, weights, ["regime"]), "forecast")


@registry.add()
def lasso_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = models.lasso_select(small(spark, sf_dir), ["ret5", "ret20", "vol20"], "fwd", 0.001)
    return spark.createDataFrame(list(kept.items()), "feature string, coefficient double")


@registry.add()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = small(spark, sf_dir).dropna(subset=["ret5", "vol20"]).select("ret5", "vol20", F.xxhash64("ticker", "date").alias("_id"))
    return models.permutation_importance(rows, ["ret5", "vol20"], lambda df: df.withColumn("prediction", F.col("ret5") + 3 * F.col("vol20")))
