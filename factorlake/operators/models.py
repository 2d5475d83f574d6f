"""MLlib-backed selection and importance: lasso by purged cross-validation, permuted forests, linear and permutation importance."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.moments import moments
from factorlake.functions.staging import cut


def with_vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x").transform(df.dropna(subset=features))


def fold_bounds(dates: DataFrame, folds: int = 5) -> DataFrame:
    """dates(date) with ``block`` 0 .. folds: blocks of the ordered calendar."""
    return dates.select("date").distinct().withColumn("block", F.ntile(folds + 1).over(Window.orderBy("date")) - 1)  # a row a date


def lasso_coefficients(sums: np.ndarray, strength: float, rounds: int = 1_000) -> np.ndarray:
    """(intercept, coefficients) that minimise mean squared error / 2 + strength * sum |coefficient|, from the sums of products of (1, features, target)."""
    n, k = sums[0, 0], len(sums) - 2
    means = sums[0, 1:] / n
    spread = sums[1:, 1:] / n - np.outer(means, means)
    beta = np.zeros(k)
    for _ in range(rounds):
        before = beta.copy()
        for j in range(k):
            if spread[j, j] > 0:
                pull = spread[j, k] - spread[j, :k] @ beta + spread[j, j] * beta[j]
                beta[j] = np.sign(pull) * max(abs(pull) - strength, 0.0) / spread[j, j]
        if np.abs(beta - before).max(initial=0.0) < 1e-12:
            break
    return np.concatenate([[means[k] - beta @ means[:k]], beta])


def lasso_cv(df: DataFrame, features: list[str], target: str, folds: int = 5, purge: int = 2, strengths: int = 20) -> tuple[float, list[tuple[float, float]]]:
    """(best strength, (strength, mean squared error) of each): expanding training windows, tests after a gap of ``purge`` dates.

    One pass gives the sums of products of each stretch of dates between the folds' limits, of values less their column's mean, which
    changes no slope and no error but keeps large means out of the differences; every training and test set is a sum of
    stretches, and fits and errors need those matrices only, which are as large as the square of the features.
    """
    calendar = fold_bounds(df, folds).withColumn("at", F.row_number().over(Window.orderBy("date")))  # a row a date
    begins = {r["block"]: r["at"] for r in calendar.groupBy("block").agg(F.min("at").alias("at")).collect()}
    tests = [f for f in range(1, folds + 1) if f in begins]
    limits = sorted({x for f in tests for x in (begins[f] - purge, begins[f])})
    zone = sum((F.col("at") >= x).cast("int") for x in limits) if limits else F.lit(0)
    rows = df.dropna(subset=[target, *features]).join(calendar, "date")
    means = rows.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in dict.fromkeys([*features, target])]).first()
    less_mean = lambda c, name: (F.col(c).cast("double") - F.lit(means[c])).alias(name)
    rows = rows.select(zone.alias("zone"), F.lit(1.0).alias("_1"), *[less_mean(c, c) for c in features], less_mean(target, "_y"))
    names, by_zone = ["_1", *features, "_y"], {}
    for r in moments(rows, names, ["zone"]).collect():
        by_zone.setdefault(r["zone"], np.zeros((len(names), len(names))))[r["i"], r["j"]] = r["s"]
    between = lambda low, high: sum((m for z, m in by_zone.items() if low <= z < high), np.zeros((len(names), len(names))))
    after = lambda at: limits.index(at) + 1  # zones from here on are at or past the limit
    errors = []
    for strength in np.geomspace(1e-4, 1.0, strengths):
        of_folds = []
        for f in tests:
            train = between(0, after(begins[f] - purge))
            test = between(after(begins[f]), after(begins[f + 1]) if f + 1 in begins else len(limits) + 1)
            if train[0, 0] and test[0, 0]:
                v = np.append(-lasso_coefficients(train, float(strength)), 1.0)
                of_folds.append(float(v @ test @ v / test[0, 0]))
        errors.append((float(strength), float(np.mean(of_folds)) if of_folds else float("inf")))
    return min(errors, key=lambda e: e[1])[0], errors


def lasso_select(df: DataFrame, features: list[str], target: str, strength: float) -> dict[str, float]:
    """Coefficients of the features that the lasso keeps."""
    rows = with_vector(df.dropna(subset=[target]), features)
    model: LinearRegressionModel = LinearRegression(featuresCol="_x", labelCol=target, regParam=strength, elasticNetParam=1.0, standardization=False).fit(rows)
    return {f: float(c) for f, c in zip(features, model.coefficients, strict=True) if abs(c) > 1e-12}


def permuted(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """rows(_id, ...) with the column's values dealt to other rows: both orders are numbered within hash ranges and joined on the number.

    Rows are numbered by their place in (part, hash), with the sizes of parts known, so no task orders all rows.
    """
    parts = 64

    def numbered(keyed: DataFrame, salt: int, keep: list[str]) -> DataFrame:
        hashed = keyed.withColumn("_h", F.xxhash64("_id", F.lit(salt))).withColumn("_part", F.floor((F.shiftright("_h", 32) + 2147483648) / (4294967296 / parts)).cast("int"))
        sizes = hashed.groupBy("_part").agg(F.count("*").alias("_n"))
        before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a part
        at = F.row_number().over(Window.partitionBy("_part").orderBy("_h", "_id"))
        return hashed.join(before, "_part").select(*keep, (F.col("_before") + at).alias("_at"))

    rest = [c for c in rows.columns if c != column]
    left = numbered(rows.select(*rest), seed, rest)
    right = numbered(rows.select("_id", column), seed + 1, [column])
    return left.join(right, "_at").drop("_at")


def mda_importance(df: DataFrame, features: list[str], target: str, trees: int = 50, depth: int = 5, seed: int = 7) -> dict[str, float]:
    """Rise of a tree's mean squared error when a feature is permuted, averaged over the forest's trees; all trees are scored in one pass a feature."""
    rows = df.dropna(subset=[*features, target]).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y"))
    rows = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(assembler.transform(rows))

    def error(r: DataFrame) -> float:
        made = assembler.transform(r)
        for b, tree in enumerate(model.trees):
            made = tree.setPredictionCol(f"_p{b}").transform(made)
        return made.agg(sum(F.avg(F.pow(F.col("_y") - F.col(f"_p{b}"), F.lit(2.0))) for b in range(len(model.trees))) / len(model.trees)).first()[0]

    base = error(rows)
    return {f: float(error(permuted(rows, f, seed + i)) - base) for i, f in enumerate(features)}


def linear_importance(df: DataFrame, features: list[str], target: str, least: int = 5) -> DataFrame:
    """(feature, importance): |Pearson| with the target over finite pairs, 0 with ``least`` or fewer; one pass."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < F.lit(float("inf"))), F.col(c).cast("double"))
    aggs = []
    for f in features:
        x, y = F.when(finite(target).isNotNull(), finite(f)), F.when(finite(f).isNotNull(), finite(target))
        r = F.abs(F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))
        aggs.append(F.coalesce(F.when(F.count(x) > least, r), F.lit(0.0)).alias(f))
    return df.agg(*aggs).unpivot([], features, "feature", "importance")


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def permutation_importance(df: DataFrame, features: list[str], predict, repeats: int = 5, seed: int = 7) -> DataFrame:
    """(feature, importance): mean change of the predictions' variance over permutations, normalised; predict(df) adds ``prediction``."""
    rows = df.dropna(subset=features).withColumn("_id", F.monotonically_increasing_id()) if "_id" not in df.columns else df.dropna(subset=features)
    rows = rows.persist()
    spread = lambda r: predict(r).agg(F.var_pop("prediction")).first()[0] or 0.0
    base = spread(rows)
    changes = {f: float(np.mean([abs(base - spread(permuted(rows, f, seed + 100 * k + i))) for k in range(repeats)])) for i, f in enumerate(features)}
    rows.unpersist()
    total = sum(changes.values()) or 1.0
    return df.sparkSession.createDataFrame([(f, c / total) for f, c in changes.items()], "feature string, importance double")
