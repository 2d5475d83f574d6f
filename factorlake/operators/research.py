"""Signal research: forward returns, information coefficients, validation, ranking, preprocessing, orthogonalisation, half-life, folds.

Features are long, (date, ticker, feature, value), wherever many are scored: one grouped job, never a loop over columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.kernels import cross_z, fill_forward, percent_rank
from factorlake.functions.moments import moments, pair_moments, to_matrix
from factorlake.functions.order_statistics import at_share, rolling_quantiles
from factorlake.functions.staging import cut

KEY = ["date", "ticker"]


def forward_returns(panel: DataFrame, horizon: int = 21) -> DataFrame:
    """(date, ticker, fwd): return over the next ``horizon`` dates; the tail without one goes."""
    made = panel.select(*KEY, F.expr(f"lead(adj_close, {horizon}) OVER (PARTITION BY ticker ORDER BY date) / nullif(adj_close, 0) - 1").alias("fwd"))
    return made.where("fwd is not null")


def ranked_pairs(long: DataFrame, forward: DataFrame) -> DataFrame:
    """Pairs of a feature and a forward return with average-tie ranks of both among the pairs of their (feature, date)."""
    pairs = long.where("value is not null").join(forward, KEY)
    part = "PARTITION BY feature, date"
    return pairs.select("feature", "date", F.expr(percent_rank("value", part)).alias("rv"), F.expr(percent_rank("fwd", part)).alias("rf"))


def ic_series(long: DataFrame, forward: DataFrame, min_obs: int = 3) -> DataFrame:
    """(feature, date, ic): Spearman correlation by date; null with fewer pairs or without variance."""
    ranks = ranked_pairs(long, forward).groupBy("feature", "date")
    sums = ranks.agg(F.count("*").alias("n"), F.covar_samp("rv", "rf").alias("c"), F.var_samp("rv").alias("a"), F.var_samp("rf").alias("b"))
    good = (F.col("n") >= min_obs) & (F.col("a") > 1e-12) & (F.col("b") > 1e-12)
    return sums.select("feature", "date", F.when(good, F.col("c") / F.sqrt(F.col("a") * F.col("b"))).alias("ic"))


#: Columns of a block: what a group of ``wide_ic_series`` holds of each row of a date.
BLOCK = 16


def wide_ic_series(parts: list[tuple[DataFrame, list[str]]], min_obs: int = 3) -> DataFrame:
    """(feature, date, ic, pairs, held, rows) of wide parts (date, fwd, columns), a block of columns of a date at a time: ``ic_series``, of how many pairs, how many values there are, and of how many rows.

    A row sends its values once, as an array a block, and a group ranks its columns one by one; no row is made of a value. Integers, as codes in the values' order are, are sent as such.
    """
    names = [n for _, own in parts for n in own]
    kind = "int" if all(df.schema[n].dataType.simpleString() == "int" for df, own in parts for n in own) else "double"
    dealt, first = [], 0
    for df, own in parts:
        blocks = [F.struct(F.lit(first + at).alias("first"), F.array(*[F.col(n).cast(kind) for n in own[at : at + BLOCK]]).alias("values")) for at in range(0, len(own), BLOCK)]
        dealt.append(df.select("date", F.col("fwd").cast("double").alias("fwd"), F.explode(F.array(*blocks)).alias("b")).select("date", "fwd", "b.first", "b.values"))
        first += len(own)

    def coefficients(group: pa.Table) -> pa.Table:
        at, date = group.column("first")[0].as_py(), group.column("date")[0]
        cells = pa.concat_arrays([c.flatten() for c in group.column("values").chunks])
        valid = cells.is_valid().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        values = cells.fill_null(0).to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        forward = group.column("fwd")
        known, forward = forward.is_valid().to_numpy(), forward.fill_null(0.0).to_numpy()
        pairs = valid & known[:, None]
        made = [rank_correlation(values[both, j], forward[both], min_obs) for j, both in enumerate(pairs.T)]
        columns = {"feature": pa.array(names[at : at + len(made)]), "date": pa.array([date.as_py()] * len(made), date.type), "ic": pa.array(made, pa.float64())}
        return pa.table(columns | {"pairs": pa.array(pairs.sum(axis=0)), "held": pa.array(valid.sum(axis=0)), "rows": pa.array([group.num_rows] * len(made))})

    whole = dealt[0]
    for part in dealt[1:]:
        whole = whole.unionByName(part)
    form = f"feature string, date {whole.schema['date'].dataType.simpleString()}, ic double, pairs long, held long, rows long"
    return whole.groupBy("date", "first").applyInArrow(coefficients, form)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Average-tie ranks from 1; a NaN is larger than any number and equal to another."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(x)))
    ranks = np.empty(len(x))
    ranks[order] = np.repeat(first + (count + 1) / 2, count)
    return ranks


def rank_correlation(x: np.ndarray, y: np.ndarray, min_obs: int) -> float | None:
    if len(x) < max(min_obs, 2):
        return None
    a, b = average_ranks(x) / len(x), average_ranks(y) / len(y)
    a, b = a - a.mean(), b - b.mean()
    aa, bb, ab = (float(s) / (len(x) - 1) for s in (a @ a, b @ b, a @ b))
    return ab / float(np.sqrt(aa * bb)) if aa > 1e-12 and bb > 1e-12 else None


def ic_icir(series: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(feature, ic, icir): mean of the series, and mean over its deviation; 0 where there is none. features: names that must appear."""
    sums = series.groupBy("feature").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"))
    if features is not None:
        sums = features.select("feature").distinct().join(sums, "feature", "left")
    return sums.select("feature", F.coalesce("m", F.lit(0.0)).alias("ic"), F.when(F.col("s") > 1e-12, F.col("m") / F.col("s")).otherwise(0.0).alias("icir"))


def spearman_pair(df: DataFrame, x: str, y: str, parts: int = 256) -> DataFrame:
    """One row (rho); 0 where it is undefined. The pairs are computed once; each column is ranked within ranges of its values, whose sizes are known, so no task orders all rows."""
    rows = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    limits = rows.approxQuantile(["x", "y"], [i / parts for i in range(1, parts)], 0.25 / parts)  # anywhere: they only part the rows
    for c, bounds in zip(("x", "y"), limits):
        rows = ranked_by_range(rows, c, sorted(set(bounds)))
    spread = F.nullif(F.stddev_samp("x") * F.stddev_samp("y"), F.lit(0.0))
    return rows.select((F.covar_samp("x", "y") / spread).alias("rho")).select(F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)).alias("rho"))


def ranked_by_range(rows: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """rows with the column's average-tie rank in its place; bounds part its values into ranges."""
    ranges = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    keyed = rows.withColumn("_part", F.aggregate(ranges, F.lit(0), lambda n, b: n + (F.col(column) > b).cast("int")))
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    rank = F.expr(f"rank() OVER (PARTITION BY _part ORDER BY {column}) + (count(*) OVER (PARTITION BY _part, {column}) - 1) / 2.0D")
    return keyed.withColumn("_rank", rank).join(F.broadcast(before), "_part").select(*[(F.col("_before") + F.col("_rank")).alias(c) if c == column else F.col(c) for c in rows.columns])


def icir_annualised(series: DataFrame, last: int = 252) -> DataFrame:
    """(feature, icir): mean over deviation times sqrt(252), of the last ``last`` values of each feature."""
    at = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("date")))
    recent = series.where("ic is not null").withColumn("at", at).where(F.col("at") <= last)
    sums = recent.groupBy("feature").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"))
    return sums.select("feature", F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("icir"))


def half_life(series: DataFrame, lags: int = 30) -> DataFrame:
    """(feature, ticker, half_life): from a log-linear fit of autocorrelations above 0.01 at lags 1 to ``lags``.

    series: (feature, ticker, date, value). Too few points give 0, a slope that doesn't fall infinity. Values are shifted in one
    window for all lags, not joined to themselves.
    """
    w = Window.partitionBy("feature", "ticker").orderBy("date")
    whole = Window.partitionBy("feature", "ticker")
    rows = series.where("value is not null").withColumn("d", F.col("value") - F.avg("value").over(whole))
    shifted = rows.select("feature", "ticker", "d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    sums = shifted.groupBy("feature", "ticker").agg(F.sum(F.col("d") * F.col("d")).alias("v"), *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    rho = sums.unpivot(["feature", "ticker", "v"], [f"s{k}" for k in range(1, lags + 1)], "lag", "s")
    rho = rho.select("feature", "ticker", F.substring("lag", 2, 3).cast("double").alias("k"), (F.col("s") / F.nullif("v", F.lit(0.0))).alias("r"))
    good = F.col("r") > 0.01
    fit = rho.groupBy("feature", "ticker").agg(F.count(F.when(good, 1)).alias("n"), F.regr_slope(F.when(good, F.log("r")), F.when(good, F.col("k"))).alias("slope"))
    decay = F.when(F.col("n") < 2, F.lit(0.0)).when(F.col("slope") >= 0, F.lit(float("inf"))).otherwise(F.log(F.lit(2.0)) / -F.col("slope"))
    return fit.select("feature", "ticker", decay.alias("half_life"))


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of all products of columns, in one pass; as large as the square of the (few) columns."""
    return to_matrix(moments(df, columns).collect(), len(columns))


def orthogonalise(df: DataFrame, signal: str, factors: list[str]) -> DataFrame:
    """df with ``residual``: the signal less its projection on the factors (no intercept), and ``residual_ratio``: the ratio of their norms."""
    rows = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_{c}") for c in (signal, *factors)])
    sums = gram(rows, [f"_{c}" for c in (signal, *factors)])
    weights = np.linalg.pinv(sums[1:, 1:]) @ sums[1:, 0] if factors else np.zeros(0)
    residual = F.col(f"_{signal}")
    for weight, factor in zip(weights, factors, strict=True):
        residual = residual - float(weight) * F.col(f"_{factor}")
    left = sums[0, 0] - 2 * weights @ sums[1:, 0] + weights @ sums[1:, 1:] @ weights
    ratio = float(np.sqrt(max(left, 0.0) / sums[0, 0])) if sums[0, 0] > 0 else 0.0
    return rows.select(*df.columns, residual.alias("residual"), F.lit(ratio).alias("residual_ratio"))


def null_fraction(long_or_wide: DataFrame, features: list[str]) -> DataFrame:
    """(feature, null_fraction), one pass over a wide matrix."""
    shares = long_or_wide.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in features])
    return shares.unpivot([], features, "feature", "null_fraction")


def validation_summary(scores: DataFrame, nulls: DataFrame, least_ic: float = 0.02, least_icir: float = 0.5, most_null: float = 0.3) -> DataFrame:
    """(feature, null_fraction, ic, icir, passed), by falling |icir|."""
    passed = (F.col("null_fraction") <= most_null) & (F.abs("ic") >= least_ic) & (F.abs("icir") >= least_icir)
    joined = nulls.join(scores, "feature", "left").fillna(0.0, ["ic", "icir"])
    return joined.select("feature", "null_fraction", "ic", "icir", passed.alias("passed")).orderBy(F.desc(F.abs("icir")), "feature")


def validate_features(matrix: DataFrame, scores: DataFrame, features: list[str], **limits) -> DataFrame:
    """The matrix with only the features that pass."""
    kept = {r["feature"] for r in validation_summary(scores, null_fraction(matrix, features), **limits).where("passed").select("feature").collect()}
    return matrix.select(*[c for c in matrix.columns if c not in features or c in kept])


def gate_signal(scores: DataFrame, least_ic: float = 0.03, least_icir: float = 0.5) -> DataFrame:
    return scores.where((F.abs("ic") >= least_ic) & (F.abs("icir") >= least_icir))


def rank_signals(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc(F.abs("icir")), "feature")


def top_signals(scores: DataFrame, n: int = 50) -> DataFrame:
    return rank_signals(scores).limit(n)


def ranking_report(scores: DataFrame, n: int = 50) -> DataFrame:
    """(rank, signal_name, ic, icir) of the first n; ranked after the limit, so over n rows."""
    ranked = top_signals(scores, n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("icir")), "feature")))
    return ranked.select("rank", F.col("feature").alias("signal_name"), F.round("ic", 5).alias("ic"), F.round("icir", 5).alias("icir"))


def pair_covariances(matrix: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, a, b, n, cov, var_a, var_b) for every ordered pair: sample moments over the rows that have both, one pass over the wide matrix."""
    names = F.array(*[F.lit(f) for f in features])
    of = lambda xy, x, y: (F.col(xy) - F.col(x) * F.col(y) / F.col("n")) / (F.col("n") - 1)
    some = pair_moments(matrix, features).where("n > 1")
    return some.select("i", "j", names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "n", of("sxy", "sx", "sy").alias("cov"), of("sxx", "sx", "sx").alias("var_a"), of("syy", "sy", "sy").alias("var_b"))


def corr_matrix(matrix: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) for a before b in the order of features: Pearson over the rows that have both; null if one doesn't vary."""
    pairs = pair_covariances(matrix, features).where("i < j")
    r = F.when((F.col("var_a") > 0) & (F.col("var_b") > 0), F.col("cov") / F.sqrt(F.col("var_a") * F.col("var_b")))
    return pairs.select("a", "b", r.alias("r"))


def cov_matrix(matrix: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, cov) for a up to b: sample covariance over the rows that have both."""
    return pair_covariances(matrix, features).where("i <= j").select("a", "b", "cov")


def redundant_features(correlations: DataFrame, most: float = 0.95) -> DataFrame:
    """(feature, max_corr): features whose largest |r| with an earlier one exceeds ``most``."""
    return correlations.groupBy(F.col("b").alias("feature")).agg(F.max(F.abs("r")).alias("max_corr")).where(F.col("max_corr") > most)


def screen_collinear(correlations: DataFrame, scores: DataFrame, features: list[str], most: float = 0.95) -> list[str]:
    """Greedy: of a feature and the kept ones that resemble it, the best |ic| stays. The table has a row for each pair of a few hundred features."""
    ic = {r["feature"]: abs(r["ic"]) for r in scores.select("feature", "ic").collect()}
    close = {(r["a"], r["b"]) for r in correlations.where(F.abs("r") > most).select("a", "b").collect()}
    kept: list[str] = []
    for feature in features:
        cluster = [k for k in kept if (k, feature) in close or (feature, k) in close]
        best = max([*cluster, feature], key=lambda f: (ic.get(f, 0.0), -features.index(f)))
        kept = [k for k in kept if k not in cluster] + [best]
    return [f for f in features if f in kept]


def winsorize_rolling(panel: DataFrame, columns: str | list[str], n: int = 252, least: int = 10, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """panel with the columns clipped to their ticker's rolling quantiles; without enough values to those of its whole series.

    One grouped map over a ticker's dates for all columns; a sorted window slides along each.
    """
    columns = [columns] if isinstance(columns, str) else columns
    panel = panel.withColumns({c: F.col(c).cast("double") for c in columns})

    def clip(series: pa.Table) -> pa.Table:
        series = series.sort_by("date")
        for c in columns:
            x = series.column(c).to_numpy(zero_copy_only=False).astype(float)
            bounds = rolling_quantiles(x, n, least, [low, high])
            held = sorted(x[~np.isnan(x)].tolist())
            bounds = np.where(np.isnan(bounds), [at_share(held, low), at_share(held, high)], bounds) if held else bounds
            clipped = np.where(x < bounds[:, 0], bounds[:, 0], np.where(x > bounds[:, 1], bounds[:, 1], x))
            series = series.set_column(series.schema.get_field_index(c), c, pa.array(clipped, mask=series.column(c).is_null().to_numpy()))
        return series

    return panel.groupBy("ticker").applyInArrow(clip, panel.schema)


def xs_zscore(panel: DataFrame, columns: str | list[str]) -> DataFrame:
    """The columns standardised by date; where one doesn't vary by 1."""
    columns = [columns] if isinstance(columns, str) else columns
    spread = lambda c: F.expr(f"coalesce(nullif(stddev_samp({c}) OVER (PARTITION BY date), 0), 1)")
    return panel.withColumns({c: (F.col(c) - F.expr(f"avg({c}) OVER (PARTITION BY date)")) / spread(c) for c in columns})


def impute_ffill_median(panel: DataFrame, columns: str | list[str], limit: int = 5) -> DataFrame:
    """Filled forward over at most ``limit`` dates, then with the date's median, then with 0."""
    columns = [columns] if isinstance(columns, str) else columns
    filled = panel.withColumns({c: F.expr(fill_forward(c, limit)) for c in columns})
    return filled.withColumns({c: F.coalesce(F.col(c), F.expr(f"percentile({c}, 0.5D) OVER (PARTITION BY date)"), F.lit(0.0)) for c in columns})


def preprocess(panel: DataFrame, columns: list[str], scores: DataFrame | None = None, most: float = 0.95) -> tuple[DataFrame, list[str]]:
    """Winsorised, standardised, imputed columns, each step for all columns at once; of collinear ones the best by ``scores`` stay."""
    panel = impute_ffill_median(xs_zscore(winsorize_rolling(panel, columns), columns), columns)
    kept = screen_collinear(corr_matrix(panel, columns), scores, columns, most) if scores is not None else columns
    return panel.drop(*[c for c in columns if c not in kept]), kept


def match_feature_name(wanted: DataFrame, scores: DataFrame) -> DataFrame:
    """(name, feature): an equal name, else one that contains the other, else the best-ranked feature.

    Both sides are short lists: hypotheses' names and the library's features.
    """
    clean = lambda c: F.lower(F.trim(F.col(c)))
    pairs = wanted.select("name").crossJoin(F.broadcast(scores.select("feature", "icir")))
    kind = F.when(clean("name") == clean("feature"), 0).when(F.contains(clean("feature"), clean("name")) | F.contains(clean("name"), clean("feature")), 1).otherwise(2)
    best = Window.partitionBy("name").orderBy("kind", F.desc(F.abs("icir")), "feature")
    return pairs.withColumn("kind", kind).withColumn("at", F.row_number().over(best)).where("at = 1").select("name", "feature")


def purged_walk_forward(dates: DataFrame, train: int, test: int, embargo: int, step: int | None = None) -> DataFrame:
    """(fold, date, role): anchored folds over an ordered calendar; train from the start, then a gap of ``embargo`` dates, then test."""
    step = step or test
    at = dates.select("date").distinct().withColumn("at", F.row_number().over(Window.orderBy("date")) - 1)
    last = dates.select("date").distinct().agg(F.count("*").alias("n"))
    folds = last.select(F.explode(F.when(F.col("n") >= train + embargo + 1, F.sequence(F.lit(0), F.floor((F.col("n") - train - embargo - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("fold"))
    begin = F.col("fold") * step + train
    role = F.when(F.col("at") < begin, "train").when((F.col("at") >= begin + embargo) & (F.col("at") < begin + embargo + test), "test")
    return at.join(F.broadcast(folds), begin + embargo + test > F.col("at")).withColumn("role", role).where("role is not null").select("fold", "date", "role")


def standardised(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.select(*KEY, *[F.expr(cross_z(c)).alias(c) for c in columns])
