"""Queries of signal research on weekly bars: a small feature matrix, its scores, screens and preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.kernels import apply_layers, change, dialect, percent_rank, roll, to_duckdb
from factorlake.functions.scalar import six_digits
from factorlake.functions.staging import cut, shared_folder
from factorlake.operators import daily_states
from factorlake.operators import panel as P
from factorlake.operators import research as R
from factorlake.plans import matrix
from factorlake.sources import derived

from .base import BARS, FUNDAMENTALS, GRID, Registry, six

registry = Registry()
FEATURES = ["ret5", "ret20", "vol20", "ret5b"]
HORIZON = 4


def _layer() -> dict[str, str]:
    return {"ret5": change("adj_close", 5), "ret20": change("adj_close", 20), "vol20": f"({roll('stddev_samp', 'returns', 20)}) * sqrt(252.0D)", "ret5b": f"2 * {change('adj_close', 5)} + 1", "fwd": f"lead(adj_close, {HORIZON}) OVER (PARTITION BY ticker ORDER BY date) / nullif(adj_close, 0) - 1"}


with dialect("duckdb"):
    _COLUMNS = ", ".join(f"{to_duckdb(sql)} AS {name}" for name, sql in _layer().items())
    _PR = to_duckdb(percent_rank("value", "PARTITION BY feature, date")), to_duckdb(percent_rank("fwd", "PARTITION BY feature, date"))
SMALL = f"{BARS}, {GRID}, small AS (SELECT * FROM (SELECT *, {_COLUMNS} FROM dense) WHERE adj_close IS NOT NULL)"
LONG = f"""{SMALL}, long AS (SELECT date, ticker, fwd, feature, value FROM (UNPIVOT (SELECT date, ticker, fwd, {', '.join(FEATURES)} FROM small) ON {', '.join(FEATURES)} INTO NAME feature VALUE value)),
ranks AS (SELECT feature, date, {_PR[0]} AS rv, {_PR[1]} AS rf FROM long WHERE fwd IS NOT NULL),
series AS (SELECT feature, date, CASE WHEN count(*) >= 3 AND var_samp(rv) > 1e-12 AND var_samp(rf) > 1e-12 THEN covar_samp(rv, rf) / sqrt(var_samp(rv) * var_samp(rf)) END AS ic FROM ranks GROUP BY 1, 2),
scores AS (SELECT feature, coalesce(avg(ic), 0) AS ic, CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS icir FROM series GROUP BY 1)"""


ROUNDED = f"(SELECT feature, {six('ic', 'ic')}, {six('icir', 'icir')} FROM scores)"


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_layers(matrix.dense(derived.bars(spark, sf_dir)), [_layer()]).where("adj_close is not null")


def long(panel: DataFrame) -> DataFrame:
    return panel.select("date", "ticker", *FEATURES).unpivot(["date", "ticker"], FEATURES, "feature", "value")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(small(spark, sf_dir))


def series_of(panel: DataFrame) -> DataFrame:
    """Coefficients by date from the wide panel: a date's values are ranked together, without a join to the returns beside them."""
    return R.wide_ic_series([(panel.select("date", "fwd", *FEATURES), FEATURES)]).where("pairs > 0").select("feature", "date", "ic")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ic_icir(series(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small matrix with its returns, written once for queries that read it several times."""
    return cut(small(spark, sf_dir).select("date", "ticker", "fwd", *FEATURES))


def rounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six digits, so features that are scaled copies of each other tie and rank by name."""
    return shown(scores(spark, sf_dir), "ic", "icir")


def shown(df: DataFrame, *numbers: str) -> DataFrame:
    return df.select(*[six_digits(F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns])


@registry.add(f"WITH {SMALL} SELECT ticker, count(fwd) AS n, {six('sum(fwd)', 'total')} FROM small WHERE fwd IS NOT NULL GROUP BY 1")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = R.forward_returns(matrix.dense(derived.bars(spark, sf_dir)), HORIZON)
    return shown(made.groupBy("ticker").agg(F.count("fwd").alias("n"), F.sum("fwd").alias("total")), "total")


@registry.add(f"WITH {LONG} SELECT feature, date, {six('ic', 'ic')} FROM series")
def ic_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(series(spark, sf_dir), "ic")


@registry.add(f"WITH {LONG} SELECT feature, {six('ic', 'ic')}, {six('icir', 'icir')} FROM scores")
def ic_icir_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scores(spark, sf_dir), "ic", "icir")


@registry.add(f"""WITH {SMALL}, r AS (SELECT rank() OVER (ORDER BY vol20) + (count(*) OVER (PARTITION BY vol20) - 1) / 2.0 AS a, rank() OVER (ORDER BY ret20) + (count(*) OVER (PARTITION BY ret20) - 1) / 2.0 AS b
  FROM small WHERE vol20 IS NOT NULL AND ret20 IS NOT NULL) SELECT {six('corr(a, b)', 'rho')} FROM r""")
def spearman_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.spearman_pair(small(spark, sf_dir), "vol20", "ret20"), "rho")


@registry.add(f"""WITH {LONG}, recent AS (SELECT feature, ic, row_number() OVER (PARTITION BY feature ORDER BY date DESC) AS k FROM series WHERE ic IS NOT NULL)
  SELECT feature, {six('CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) * sqrt(252) ELSE 0 END', 'icir')} FROM recent WHERE k <= 252 GROUP BY 1""")
def icir_annualised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.icir_annualised(series(spark, sf_dir)), "icir")


@registry.add(f"""WITH {LONG}, d AS (SELECT feature, ticker, value - avg(value) OVER (PARTITION BY feature, ticker) AS d, row_number() OVER (PARTITION BY feature, ticker ORDER BY date) AS pos FROM long),
  v AS (SELECT feature, ticker, sum(d * d) AS v FROM d GROUP BY 1, 2),
  s AS (SELECT x.feature, x.ticker, k, sum(x.d * y.d) AS s FROM d x, range(1, 31) r(k), d y WHERE y.feature = x.feature AND y.ticker = x.ticker AND y.pos = x.pos - k GROUP BY 1, 2, 3),
  rho AS (SELECT feature, ticker, k, s / nullif(v, 0) AS r FROM s JOIN v USING (feature, ticker)),
  fit AS (SELECT feature, ticker, count(*) FILTER (r > 0.01) AS n, regr_slope(CASE WHEN r > 0.01 THEN ln(r) END, CASE WHEN r > 0.01 THEN k END) AS slope FROM rho GROUP BY 1, 2)
  SELECT feature, ticker, {six("CASE WHEN n < 2 THEN 0 WHEN slope >= 0 THEN -1 ELSE ln(2) / -slope END", 'half_life')} FROM fit""")
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = R.half_life(long(small(spark, sf_dir)))
    return shown(made.withColumn("half_life", F.when(F.col("half_life") == float("inf"), -1.0).otherwise(F.col("half_life"))), "half_life")


@registry.add(f"""WITH {SMALL}, z AS (SELECT ticker, coalesce(ret20, 0) AS s, coalesce(vol20, 0) AS f FROM small), b AS (SELECT sum(s * f) / sum(f * f) AS b, sum(s * s) AS ss FROM z),
  t AS (SELECT sqrt(sum((s - b * f) * (s - b * f)) / max(ss)) AS ratio FROM z, b)
  SELECT ticker, {six('sum((s - b * f) * (s - b * f))', 'squares')}, {six('max(ratio)', 'ratio')} FROM z, b, t GROUP BY 1""")
def orthogonalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = R.orthogonalise(small(spark, sf_dir), "ret20", ["vol20"])
    return shown(made.groupBy("ticker").agg(F.sum(F.col("residual") * F.col("residual")).alias("squares"), F.max("residual_ratio").alias("ratio")), "squares", "ratio")


_NULLS = f"nulls AS (SELECT feature, null_fraction FROM (UNPIVOT (SELECT {', '.join(f'avg(({f} IS NULL)::INT) AS {f}' for f in FEATURES)} FROM small) ON {', '.join(FEATURES)} INTO NAME feature VALUE null_fraction))"
_SUMMARY = f"{LONG}, {_NULLS}, summary AS (SELECT feature, null_fraction, coalesce(ic, 0) AS ic, coalesce(icir, 0) AS icir, null_fraction <= 0.3 AND abs(coalesce(ic, 0)) >= 0.02 AND abs(coalesce(icir, 0)) >= 0.1 AS passed FROM nulls LEFT JOIN scores USING (feature))"


@registry.add(f"WITH {SMALL}, {_NULLS} SELECT feature, {six('null_fraction', 'null_fraction')} FROM nulls")
def null_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.null_fraction(small(spark, sf_dir), FEATURES), "null_fraction")


@registry.add(f"WITH {_SUMMARY} SELECT feature, {six('null_fraction', 'null_fraction')}, {six('ic', 'ic')}, {six('icir', 'icir')}, passed FROM summary")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stored(spark, sf_dir)
    made = R.validation_summary(R.ic_icir(series_of(panel)), R.null_fraction(panel, FEATURES), least_icir=0.1)
    return shown(made, "null_fraction", "ic", "icir")


@registry.add(f"WITH {_SUMMARY} SELECT feature FROM summary WHERE passed")
def validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stored(spark, sf_dir)
    kept = R.validate_features(panel, R.ic_icir(series_of(panel)), FEATURES, least_icir=0.1)
    counts = kept.agg(F.count("*").alias("n"), *[F.max(F.lit(f)).alias(f) for f in FEATURES if f in kept.columns])
    names = [f for f in FEATURES if f in kept.columns]
    return counts.unpivot(["n"], names, "name", "feature").select("feature") if names else counts.where("false").select(F.lit("").alias("feature"))


@registry.add(f"WITH {LONG} SELECT feature, {six('ic', 'ic')}, {six('icir', 'icir')} FROM scores WHERE abs(ic) >= 0.01 AND abs(icir) >= 0.05")
def gate_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.gate_signal(scores(spark, sf_dir), 0.01, 0.05), "ic", "icir")


@registry.add(f"WITH {LONG} SELECT CAST(row_number() OVER (ORDER BY abs(icir) DESC, feature) AS INTEGER) AS rank, feature AS signal_name, round(ic, 5) AS ic, round(icir, 5) AS icir FROM {ROUNDED}")
def ranking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranking_report(rounded_scores(spark, sf_dir), 50)


@registry.add(f"WITH {LONG} SELECT feature, icir FROM {ROUNDED} ORDER BY abs(icir) DESC, feature LIMIT 2")
def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_signals(rounded_scores(spark, sf_dir).select("feature", "icir"), 2)


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]


@registry.add(f"WITH {SMALL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {six(f'corr({a}, {b})', 'r')} FROM small" for a, b in _PAIRS))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.corr_matrix(small(spark, sf_dir), FEATURES), "r")


def split_at_last_tenth(panel: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The panel written once, and its rows up to a tenth of the time before the end, then the others: what is stored first, and what is added."""
    panel = cut(panel)
    first, last = panel.agg(F.min("date"), F.max("date")).first()
    limit = F.lit(last - (last - first) / 10)
    return panel, [panel.where(F.col("date") <= limit), panel.where(F.col("date") > limit)]


def states_of(spark: SparkSession, schema: str) -> daily_states.DailyStates:
    from uuid import uuid4

    return daily_states.DailyStates(spark, f"{shared_folder(spark)}/states-{uuid4().hex}", schema)


@registry.add(registry.sql["corr_matrix"])
def corr_matrix_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table from daily states to which the last dates were added later."""
    states = states_of(spark, daily_states.PAIRS)
    for part in split_at_last_tenth(small(spark, sf_dir))[1]:
        states.add(daily_states.pair_states(part, FEATURES))
    return shown(daily_states.correlations(states.between(), FEATURES), "r")


@registry.add(registry.sql["ic_icir_all"])
def ic_icir_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores from daily coefficients to which the last dates were added later."""
    states = states_of(spark, daily_states.SCORES)
    for part in split_at_last_tenth(small(spark, sf_dir))[1]:
        states.add(daily_states.ic_states(long(part), part.select("date", "ticker", "fwd").where("fwd is not null")))
    return shown(R.ic_icir(states.between()), "ic", "icir")


@registry.add(f"WITH {SMALL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {six(f'covar_samp({a}, {b})', 'cov')} FROM small" for i, a in enumerate(FEATURES) for b in FEATURES[i:]))
def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.cov_matrix(small(spark, sf_dir), FEATURES), "cov")


@registry.add(f"WITH {SMALL}, p AS (" + " UNION ALL ".join(f"SELECT '{b}' AS feature, abs(corr({a}, {b})) AS r FROM small" for a, b in _PAIRS) + f") SELECT feature, {six('max(r)', 'max_corr')} FROM p GROUP BY 1 HAVING max(r) > 0.95")
def redundant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.redundant_features(R.corr_matrix(small(spark, sf_dir), FEATURES)), "max_corr")


@registry.add()
def screen_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = stored(spark, sf_dir)
    kept = R.screen_collinear(R.corr_matrix(panel, FEATURES), R.ic_icir(series_of(panel)), FEATURES)
    return R.null_fraction(panel, kept)


_WIN = "{agg}(ret5) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
_BOUND = "coalesce(CASE WHEN count(ret5) OVER w >= 10 THEN quantile_cont(ret5, {p}) OVER w END, quantile_cont(ret5, {p}) OVER (PARTITION BY ticker))"
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
WINSOR = f"{SMALL}, bounds AS (SELECT *, {_BOUND.format(p=0.01)} AS lo, {_BOUND.format(p=0.99)} AS hi FROM small {_W}), winsor AS (SELECT date, ticker, CASE WHEN ret5 < lo THEN lo WHEN ret5 > hi THEN hi ELSE ret5 END AS x FROM bounds)"
ZED = "zed AS (SELECT date, ticker, (x - avg(x) OVER (PARTITION BY date)) / coalesce(nullif(stddev_samp(x) OVER (PARTITION BY date), 0), 1) AS x FROM winsor)"
FILLED = "filled AS (SELECT date, ticker, last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x FROM zed), imputed AS (SELECT date, ticker, coalesce(x, quantile_cont(x, 0.5) OVER (PARTITION BY date), 0) AS x FROM filled)"
_BY = "ticker, count({x}) AS n, " + six("min({x})", "lo") + ", " + six("max({x})", "hi") + ", " + six("avg(abs({x}))", "size")


def by_ticker(df: DataFrame, x: str) -> DataFrame:
    return shown(df.groupBy("ticker").agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(F.abs(x)).alias("size")), "lo", "hi", "size")


@registry.add(f"WITH {WINSOR} SELECT {_BY.format(x='x')} FROM winsor GROUP BY ticker")
def winsorize_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_ticker(R.winsorize_rolling(small(spark, sf_dir), "ret5"), "ret5")


@registry.add(f"WITH {WINSOR}, {ZED} SELECT {_BY.format(x='x')} FROM zed GROUP BY ticker")
def xs_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_ticker(R.xs_zscore(R.winsorize_rolling(small(spark, sf_dir), "ret5"), "ret5"), "ret5")


@registry.add(f"WITH {WINSOR}, {ZED}, {FILLED} SELECT {_BY.format(x='x')} FROM imputed GROUP BY ticker")
def preprocess_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = R.preprocess(small(spark, sf_dir), ["ret5"])
    return by_ticker(made, "ret5")


@registry.add(f"WITH {SMALL}, winsor AS (SELECT date, ticker, ret20 AS x FROM small), {FILLED.replace('FROM zed', 'FROM winsor')} SELECT {_BY.format(x='x')} FROM imputed GROUP BY ticker")
def impute_ffill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_ticker(R.impute_ffill_median(small(spark, sf_dir), "ret20"), "ret20")


@registry.add(f"""WITH {LONG}, wanted AS (SELECT DISTINCT CASE WHEN event_type IS NULL THEN '' ELSE ' ' || upper(substr(event_type, 1, 1)) END AS name FROM events UNION SELECT 'RET20 ' UNION SELECT 'vol'),
  c AS (SELECT name, feature, icir, CASE WHEN lower(trim(name)) = lower(feature) THEN 0 WHEN contains(lower(feature), lower(trim(name))) OR contains(lower(trim(name)), lower(feature)) THEN 1 ELSE 2 END AS kind FROM wanted, {ROUNDED})
  SELECT name, feature FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, abs(icir) DESC, feature) AS k FROM c) WHERE k = 1""")
def match_feature_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = derived.table(spark, sf_dir, "events").select(F.coalesce(F.concat(F.lit(" "), F.upper(F.substring("event_type", 1, 1))), F.lit("")).alias("name"))
    wanted = first.unionByName(spark.createDataFrame([("RET20 ",), ("vol",)], "name string")).distinct()
    return R.match_feature_name(wanted, rounded_scores(spark, sf_dir))


@registry.add(f"""WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM bars)), n AS (SELECT count(*) AS n FROM d),
  f AS (SELECT unnest(range(0, CAST(floor((n - 100 - 2 - 1) / 26.0) AS BIGINT) + 1)) AS fold FROM n WHERE n >= 103)
  SELECT CAST(fold AS INTEGER) AS fold, date, CASE WHEN k < fold * 26 + 100 THEN 'train' ELSE 'test' END AS role FROM f, d
  WHERE k < fold * 26 + 100 OR (k >= fold * 26 + 102 AND k < fold * 26 + 128)""")
def purged_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.purged_walk_forward(derived.bars(spark, sf_dir), train=100, test=26, embargo=2)


@registry.add(f"WITH {SMALL} SELECT date, {six('avg(returns)', 'market')}, {six('stddev_samp(returns)', 'dispersion')}, {six('quantile_cont(returns, 0.3)', 'q30')} FROM small GROUP BY 1")
def market_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = small(spark, sf_dir).groupBy("date").agg(F.avg("returns").alias("market"), F.stddev_samp("returns").alias("dispersion"), F.expr("percentile(returns, 0.3D)").alias("q30"))
    return shown(made, "market", "dispersion", "q30")


@registry.add(f"WITH {FUNDAMENTALS} SELECT ticker, arg_min(sector, (-k, sector)) AS sector FROM (SELECT ticker, sector, count(*) AS k FROM fundamentals WHERE sector IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def mode_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mode_per_key(derived.fundamentals(spark, sf_dir), "ticker", "sector")


@registry.add(f"""WITH {SMALL}, {FUNDAMENTALS} SELECT s.ticker, count(*) AS n, count(pe_ratio) AS n_pe FROM small s LEFT JOIN fundamentals f ON f.ticker = s.ticker AND f.date = s.date GROUP BY 1""")
def join_left_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = P.join_left_panel(small(spark, sf_dir), derived.fundamentals(spark, sf_dir))
    return joined.groupBy("ticker").agg(F.count("*").alias("n"), F.count("pe_ratio").alias("n_pe"))


@registry.add(f"""WITH {SMALL}, {FUNDAMENTALS} SELECT coalesce(s.ticker, f.ticker) AS ticker, count(*) AS n, count(ret5) AS n_ret, count(roe) AS n_roe FROM small s FULL JOIN fundamentals f ON f.ticker = s.ticker AND f.date = s.date GROUP BY 1""")
def join_features_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = P.join_features_outer([(small(spark, sf_dir), ["ret5"]), (derived.fundamentals(spark, sf_dir), ["roe"])])
    return joined.groupBy("ticker").agg(F.count("*").alias("n"), F.count("ret5").alias("n_ret"), F.count("roe").alias("n_roe"))


@registry.add(f"""WITH {SMALL}, {FUNDAMENTALS}, j AS (SELECT s.date, s.ticker, roe FROM small s LEFT JOIN fundamentals f ON f.ticker = s.ticker AND f.date = s.date),
  k AS (SELECT ticker, coalesce(last_value(roe IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date), 0) AS roe FROM j) SELECT ticker, {six('sum(roe)', 'roe')}, 0.0::DOUBLE AS absent FROM k GROUP BY 1""")
def join_optional_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = P.join_optional_named(small(spark, sf_dir), ["roe", "absent"], derived.fundamentals(spark, sf_dir).select("date", "ticker", "roe"))
    return shown(joined.groupBy("ticker").agg(F.sum("roe").alias("roe"), F.sum("absent").alias("absent")), "roe")


@registry.add(f"""WITH {BARS}, {FUNDAMENTALS} SELECT date FROM bars UNION SELECT date FROM fundamentals""")
def union_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.union_dates(derived.bars(spark, sf_dir), derived.fundamentals(spark, sf_dir))


@registry.add(f"""WITH {SMALL} SELECT date, coalesce(returns, 0) AS returns FROM small WHERE ticker = '1'""")
def slice_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.slice_ticker(small(spark, sf_dir), "1", ["returns"])


@registry.add(f"WITH {BARS} SELECT ticker, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close, {six('arg_max(close, date) / nullif(arg_min(close, date), 0) - 1', 'change')} FROM bars GROUP BY 1")
def period_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factorlake.operators import tables

    return shown(tables.period_change_summary(derived.bars(spark, sf_dir)), "change")
