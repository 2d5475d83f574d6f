"""Regimes, change-points, forecast baselines and their combination, for all series at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_date():
    return Window.partitionBy("ticker").orderBy("date")


def regime_features(panel: DataFrame, n: int = 20) -> DataFrame:
    """(ticker, date, ret, vol): returns and the population deviation of the n before; rows with fewer go."""
    before = by_date().rowsBetween(-n, -1)
    rows = panel.where("returns is not null").select("ticker", "date", F.col("returns").alias("ret"), F.stddev_pop("returns").over(before).alias("vol"), F.count("returns").over(before).alias("k"))
    return rows.where(F.col("k") == n).drop("k")


def regime_rule(panel: DataFrame, n: int = 20) -> DataFrame:
    """(ticker, date, regime) of every date by its last n returns: high_vol, bear or bull; bull with fewer than five."""
    last = by_date().rowsBetween(-(n - 1), 0)
    rows = panel.where("returns is not null").select("ticker", "date", F.stddev_pop("returns").over(last).alias("s"), F.avg("returns").over(last).alias("m"), F.count("returns").over(last).alias("k"))
    regime = F.when(F.col("k") < 5, "bull").when(F.col("s") * F.sqrt(F.lit(252.0)) > 0.25, "high_vol").when(F.col("m") < -0.0005, "bear").otherwise("bull")
    return rows.select("ticker", "date", regime.alias("regime"))


def regime_probs_rule(regimes: DataFrame) -> DataFrame:
    """Regimes with a map of probabilities: 0.8 for the chosen, 0.1 for each other."""
    names = ("bull", "bear", "high_vol")
    p = lambda name: F.when(F.col("regime") == name, 0.8).otherwise(0.1)
    return regimes.withColumn("probs", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[p(n) for n in names])))


def regime_cluster(features: DataFrame, seed: int = 7) -> DataFrame:
    """(ticker, date, regime) from a mixture of three Gaussians on (ret, vol): the most volatile is high_vol, of the others the lower mean bear."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["ret", "vol"], outputCol="x").transform(features.dropna())
    model = GaussianMixture(featuresCol="x", k=3, seed=seed).fit(rows)
    means = [g.mean.toArray() for g in model.gaussians]
    high = max(range(3), key=lambda i: means[i][1])
    bear, bull = sorted((i for i in range(3) if i != high), key=lambda i: means[i][0])
    names = {high: "high_vol", bear: "bear", bull: "bull"}
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return model.transform(rows).select("ticker", "date", label[F.col("prediction")].alias("regime"))


def cusum(series: DataFrame, drift: float = 0.5, threshold: float = 3.0) -> DataFrame:
    """(ticker, date, side): alarms of a two-sided cumulative sum of standardised values, reset after each; short or flat series have none.

    The fold over a ticker's dates is sequential; tickers run side by side.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date").dropna(subset=["value"])
        x = rows.value.to_numpy(float)
        out = {"ticker": [], "date": [], "side": []}
        if len(x) >= 10 and x.std() >= 1e-10:
            up = down = 0.0
            for at, z in enumerate((x - x.mean()) / x.std()):
                up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
                if up > threshold or down > threshold:
                    out["ticker"].append(rows.ticker.iloc[at])
                    out["date"].append(rows.date.iloc[at])
                    out["side"].append("up" if up > threshold else "down")
                    up = down = 0.0
        return pd.DataFrame(out, columns=["ticker", "date", "side"]).astype({"ticker": str, "date": "datetime64[ns]", "side": str})

    return series.select("ticker", F.col("date").cast("timestamp").alias("date"), "value").groupBy("ticker").applyInPandas(fold, "ticker string, date timestamp, side string")


def dl_feature_matrix(panel: DataFrame) -> DataFrame:
    """(ticker, date, signal, ret, log_change, vol): inputs of sequence models; firsts are 0."""
    prev = F.lag("close").over(by_date())
    last = by_date().rowsBetween(-19, 0)
    vol = F.when(F.count("returns").over(last) == 20, F.stddev_pop("returns").over(last)).otherwise(0.0)
    return panel.select("ticker", "date", "signal", F.coalesce("returns", F.lit(0.0)).alias("ret"), F.coalesce(F.log(F.col("close") / F.nullif(prev, F.lit(0.0))), F.lit(0.0)).alias("log_change"), vol.alias("vol"))


def sliding_sequences(matrix: DataFrame, columns: list[str], target: str, lookback: int) -> DataFrame:
    """(ticker, date, x, y): the ``lookback`` rows before each date as an array of structs, and its target."""
    before = by_date().rowsBetween(-lookback, -1)
    rows = matrix.select("ticker", "date", F.collect_list(F.struct(*columns)).over(before).alias("x"), F.col(target).alias("y"))
    return rows.where(F.size("x") == lookback)


def forecast_drift(series: DataFrame, horizons: list[int]) -> DataFrame:
    """(ticker, horizon, forecast): last plus h times the mean step."""
    ends = series.where("value is not null").groupBy("ticker").agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.count("*").alias("n"))
    h = F.explode(F.array(*[F.lit(x) for x in horizons])).alias("horizon")
    return ends.select("ticker", "first", "last", "n", h).select("ticker", "horizon", (F.col("last") + F.col("horizon") * (F.col("last") - F.col("first")) / F.col("n")).alias("forecast"))


def forecast_ar1(series: DataFrame, horizons: list[int]) -> DataFrame:
    """(ticker, horizon, forecast): last times the lag-one correlation to the power h; a correlation that is undefined is 0."""
    rows = series.where("value is not null").withColumn("before", F.lag("value").over(by_date()))
    both = F.when(F.col("before").isNotNull(), F.col("value"))
    rho = F.covar_samp("value", "before") / F.nullif(F.stddev_samp(both) * F.stddev_samp("before"), F.lit(0.0))
    ends = rows.groupBy("ticker").agg(F.max_by("value", "date").alias("last"), F.coalesce(rho, F.lit(0.0)).alias("rho"))
    return ends.select("ticker", "last", "rho", F.explode(F.array(*[F.lit(x) for x in horizons])).alias("horizon")).select("ticker", "horizon", (F.col("last") * F.pow("rho", "horizon")).alias("forecast"))


def forecast_ols(panel: DataFrame, features: list[str], target: str, horizons: list[int], least: int = 10) -> DataFrame:
    """(ticker, horizon, forecast): least squares of the target on all features, without intercept, applied to a ticker's last row of features and scaled by sqrt(h).

    Sums of products are grouped by ticker; only systems as large as the square of the features are solved in Python. A ticker with ``least``
    whole rows or fewer has coefficients 0.
    """
    numbers = [F.col(c).cast("double") for c in features]
    known = panel.select("ticker", "date", F.col(target).cast("double").alias("_y"), *[x.alias(f"_x{i}") for i, x in enumerate(numbers)])
    whole = known.dropna(subset=[c for c in known.columns if c.startswith("_")])
    k = len(features)
    xs = [f"_x{i}" for i in range(k)]
    products = [F.sum(F.col(a) * F.col(b)) for a in xs for b in xs]
    sums = whole.groupBy("ticker").agg(F.count("*").alias("n"), F.array(*products).alias("xx"), F.array(*[F.sum(F.col(a) * F.col("_y")) for a in xs]).alias("xy"))
    last = known.dropna(subset=xs).groupBy("ticker").agg(F.max_by(F.array(*xs), "date").alias("x"))

    def solve(batches):
        for rows in batches:
            fits = [np.linalg.pinv(np.array(r.xx).reshape(k, k), rcond=1e-12, hermitian=True) @ np.array(r.xy) if r.n > least else np.zeros(k) for r in rows.itertuples()]
            yield pd.DataFrame({"ticker": rows["ticker"], "value": [float(np.array(x) @ b) for x, b in zip(rows["x"], fits, strict=True)]})

    made = last.join(sums, "ticker").mapInPandas(solve, "ticker string, value double")
    return made.select("ticker", "value", F.explode(F.array(*[F.lit(x) for x in horizons])).alias("horizon")).select("ticker", "horizon", (F.col("value") * F.sqrt("horizon")).alias("forecast"))


def ensemble_weights(errors: DataFrame) -> DataFrame:
    """(model, weight): inverse mean squared errors, normalised; errors: (model, mse)."""
    inverse = errors.groupBy("model").agg((1.0 / F.greatest(F.coalesce(F.avg("mse"), F.lit(1.0)), F.lit(1e-10))).alias("w"))
    return inverse.select("model", (F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).alias("weight"))  # a row a model


def ensemble_combine(forecasts: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(ticker, horizon, forecast): weighted sums over models; weights may depend on more columns, as a regime."""
    key = [*(by or []), "model"]
    return forecasts.join(weights, key).groupBy("ticker", "horizon").agg(F.sum(F.col("forecast") * F.col("weight")).alias("forecast"))


def regime_weights(spark, table: dict[str, dict[str, float]]) -> DataFrame:
    """(regime, model, weight) of fixed weights."""
    return spark.createDataFrame([(r, m, float(w)) for r, models in table.items() for m, w in models.items()], "regime string, model string, weight double")


def sharpe_of(returns: Column) -> Column:
    return F.avg(returns) / F.nullif(F.stddev_samp(returns), F.lit(0.0)) * F.sqrt(F.lit(252.0))


