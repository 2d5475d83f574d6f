"""Queries of the feature families; each returns a digest by (feature, ticker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.kernels import dialect, layers_sql, percent_rank, to_duckdb
from factorlake.functions.scalar import from_six_digit_codes, six_digits, with_six_digit_codes
from factorlake.functions.staging import cut
from factorlake.operators import panel as P
from factorlake.operators import research
from factorlake.plans import features as families
from factorlake.plans import matrix
from factorlake.sources import derived
from factorlake.sources.sinks import keyed_part

from .base import ASOF, BARS, FUNDAMENTALS, GRID, Registry, six

registry = Registry()

_SPANS = families.EMA_SPANS
_step = lambda y, x, a, gap: f"CASE WHEN {x} IS NULL THEN {y} WHEN {y} IS NULL THEN {x} ELSE (power(1 - {a}, {gap} + 1) * {y} + {a} * {x}) / (power(1 - {a}, {gap} + 1) + {a}) END"
_alpha = lambda span: f"(2.0 / {span + 1})"
_new = {s: _step(f"e.ema{s}", "n.adj_close", _alpha(s), "e.gap") for s in _SPANS}
_line = {m: f"({_new[fast]}) - ({_new[slow]})" for m, (fast, slow, _) in families.MACD.items()}
EMAS = f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM dense),
emas AS (SELECT ticker, pos, 0 AS gap, {', '.join(f'adj_close AS ema{s}' for s in _SPANS)}, {', '.join(f'adj_close - adj_close AS {m}_line, adj_close - adj_close AS {m}_signal' for m in families.MACD)} FROM numbered WHERE pos = 1
  UNION ALL SELECT n.ticker, n.pos, CASE WHEN n.adj_close IS NULL THEN e.gap + 1 ELSE 0 END, {', '.join(_new[s] for s in _SPANS)},
  {', '.join(f"{_line[m]}, CASE WHEN e.{m}_signal IS NULL THEN {_line[m]} ELSE (1 - {_alpha(s)}) * e.{m}_signal + {_alpha(s)} * ({_line[m]}) END" for m, (_, _, s) in families.MACD.items())}
  FROM emas e JOIN numbered n ON n.ticker = e.ticker AND n.pos = e.pos + 1),
with_emas AS (SELECT d.*, {', '.join(f'ema{s}' for s in _SPANS)}, {', '.join(f'{m}_line, {m}_signal' for m in families.MACD)} FROM numbered d JOIN emas e ON e.ticker = d.ticker AND e.pos = d.pos)"""
HOME = """
sector_counts AS (SELECT ticker, sector, count(*) AS k FROM asof_panel WHERE sector IS NOT NULL GROUP BY 1, 2),
homes AS (SELECT ticker, arg_min(sector, (-k, sector)) AS home FROM sector_counts GROUP BY 1),
with_home AS (SELECT a.*, home FROM asof_panel a LEFT JOIN homes h ON h.ticker = a.ticker)"""
REPORTS = """
reports AS (SELECT d.date, t.ticker, f.* EXCLUDE (date, ticker), f.date IS NOT NULL AS held
  FROM (SELECT DISTINCT date FROM fundamentals) d CROSS JOIN (SELECT DISTINCT ticker FROM fundamentals) t LEFT JOIN fundamentals f ON f.date = d.date AND f.ticker = t.ticker)"""


def digest_sql(ctes: str, source: str, family, kept: str = "adj_close IS NOT NULL", *args) -> str:
    with dialect("duckdb"):
        layers, names = family(*args)
        body = layers_sql(source, layers)
    return f"""WITH RECURSIVE {ctes},
features AS (SELECT ticker, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in names)} FROM {body} WHERE {kept}),
long AS (UNPIVOT features ON {', '.join(names)} INTO NAME feature VALUE value)
SELECT feature, ticker, count(*) AS n, {six('min(value)', 'lo')}, {six('max(value)', 'hi')}, {six('avg(value)', 'mean')} FROM long GROUP BY 1, 2"""


@registry.add(digest_sql(f"{BARS}, {GRID}, {EMAS}", "with_emas", families.momentum))
def features_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.family_digest(*matrix.momentum_plan(derived.bars(spark, sf_dir)))


@registry.add(digest_sql(f"{BARS}, {GRID}", "dense", families.volatility))
def features_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.family_digest(*matrix.volatility_plan(derived.bars(spark, sf_dir)))


@registry.add(digest_sql(f"{BARS}, {GRID}", "dense", families.volume))
def features_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.family_digest(*matrix.volume_plan(derived.bars(spark, sf_dir)))


@registry.add(digest_sql(f"{BARS}, {GRID}", "dense", families.technical))
def features_technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.family_digest(*matrix.technical_plan(derived.bars(spark, sf_dir)))


@registry.add(digest_sql(f"{BARS}, {GRID}, {FUNDAMENTALS}, {ASOF}", "asof_panel", families.value))
def features_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.family_digest(*matrix.value_plan(derived.bars(spark, sf_dir), derived.fundamentals(spark, sf_dir)))


@registry.add(digest_sql(f"{FUNDAMENTALS}, {REPORTS}", "reports", families.quality, "held"))
def features_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.digest(*matrix.quality(derived.fundamentals(spark, sf_dir)))


@registry.add(digest_sql(f"{BARS}, {GRID}, {FUNDAMENTALS}, {ASOF}, {HOME}", "with_home", families.alternative))
def features_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.family_digest(*matrix.alternative_plan(derived.bars(spark, sf_dir), derived.fundamentals(spark, sf_dir)))


_NAMED = {"quality_roe": "roe", "quality_roa": "roa", "quality_gross_margin": "gross_margin", "value_pe_ratio": "pe_ratio", "value_dividend_yield": "dividend_yield"}


@registry.add(f"""WITH {BARS}, {GRID}, {FUNDAMENTALS}, weekly AS (SELECT date_trunc('week', date)::TIMESTAMP AS date, ticker, {', '.join(f'{c} AS {n}' for n, c in _NAMED.items())} FROM fundamentals),
  filled AS (SELECT ticker, adj_close, {', '.join(f'coalesce(last_value(w.{n} IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {n}' for n in _NAMED)} FROM dense d LEFT JOIN weekly w USING (date, ticker)),
  features AS (SELECT ticker, {', '.join(f'{n}' if n in _NAMED else f'0.0::DOUBLE AS {n}' for n in families.base_named())} FROM filled WHERE adj_close IS NOT NULL),
  long AS (UNPIVOT features ON {', '.join(families.base_named())} INTO NAME feature VALUE value)
  SELECT feature, ticker, count(*) AS n, {six('min(value)', 'lo')}, {six('max(value)', 'hi')}, {six('avg(value)', 'mean')} FROM long GROUP BY 1, 2""")
def features_base_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factory's named columns: some from fundamentals of the week, the others 0."""
    weekly = derived.fundamentals(spark, sf_dir).select(F.date_trunc("week", "date").alias("date"), "ticker", *[F.col(c).alias(n) for n, c in _NAMED.items()])
    plan = matrix.base_factory_plan(derived.bars(spark, sf_dir), weekly, named=True)
    return matrix.family_digest(*plan, wanted=families.base_named())


@registry.add(digest_sql(f"{BARS}, {GRID}", "dense", families.base_factory))
def features_base_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.family_digest(*matrix.base_factory_plan(derived.bars(spark, sf_dir)))


_FAMILIES = {
    "momentum": ("with_emas", families.momentum, "adj_close IS NOT NULL"), "val": ("asof_panel", families.value, "adj_close IS NOT NULL"), "qual": ("reports", families.quality, "held"), "volat": ("dense", families.volatility, "adj_close IS NOT NULL"),
    "vol": ("dense", families.volume, "adj_close IS NOT NULL"), "tech": ("dense", families.technical, "adj_close IS NOT NULL"), "alt": ("with_home", families.alternative, "adj_close IS NOT NULL"),
}


def whole_sql() -> tuple[str, list[str], list[str]]:
    """CTEs up to ``composites`` (every feature by (date, ticker)), the names of the families' features and of the composites."""
    parts, taken = [], []
    with dialect("duckdb"):
        for cte, (source, family, kept) in _FAMILIES.items():
            layers, names = family()
            own = [n for n in names if n not in taken]
            taken += own
            parts.append(f"f_{cte} AS (SELECT date, ticker, {', '.join(own)} FROM {layers_sql(source, layers)} WHERE {kept})")
        layers, more = families.composite([c for c in taken if c.startswith(("rank_", "zscore_"))])
        body = layers_sql("matrix", layers)
    joined = f"matrix AS (SELECT * FROM f_momentum {' '.join(f'FULL JOIN f_{c} USING (date, ticker)' for c in list(_FAMILIES)[1:])})"
    more = [m for m in more if m not in taken]
    ctes = f"{BARS}, {GRID}, {EMAS}, {FUNDAMENTALS}, {ASOF}, {HOME}, {REPORTS}, {', '.join(parts)}, {joined}, composites AS (SELECT * FROM {body})"
    return ctes, taken, more


_CTES, _NAMES, _COMPOSITES = whole_sql()


_ALL = [*_NAMES, *_COMPOSITES]
_CELLS = ", ".join(f"{{'feature': '{n}', 'n': count({n}), 'lo': min(CAST({n} AS DOUBLE)), 'hi': max(CAST({n} AS DOUBLE)), 'mean': avg(CAST({n} AS DOUBLE))}}" for n in _ALL)


@registry.add(f"WITH RECURSIVE {_CTES}, cells AS (SELECT unnest([{_CELLS}], recursive := true) FROM composites) SELECT feature, n, {six('lo', 'lo')}, {six('hi', 'hi')}, {six('mean', 'mean')} FROM cells")
def features_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, n, lo, hi, mean) of every feature of the whole matrix."""
    return matrix.whole_summary(derived.bars(spark, sf_dir), derived.fundamentals(spark, sf_dir))


with dialect("duckdb"):
    _PR = [to_duckdb(percent_rank(x, "PARTITION BY feature, date")) for x in ("value", "fwd")]
#: Scores of every feature, of values to six digits, so that equal values are equal in any order of summation.
_SCORED = f"""{_CTES}, fwds AS (SELECT date, ticker, lead(adj_close, 4) OVER (PARTITION BY ticker ORDER BY date) / nullif(adj_close, 0) - 1 AS fwd FROM dense),
features AS (SELECT date, ticker, {', '.join(six(n, n) for n in _ALL)} FROM composites), long AS (SELECT * FROM (UNPIVOT features ON {', '.join(_ALL)} INTO NAME feature VALUE value) JOIN fwds USING (date, ticker) WHERE fwd IS NOT NULL),
ranks AS (SELECT feature, date, {_PR[0]} AS rv, {_PR[1]} AS rf FROM long),
series AS (SELECT feature, date, CASE WHEN count(*) >= 3 AND var_samp(rv) > 1e-12 AND var_samp(rf) > 1e-12 THEN covar_samp(rv, rf) / sqrt(var_samp(rv) * var_samp(rf)) END AS ic FROM ranks GROUP BY 1, 2),
scores AS (SELECT feature, coalesce(avg(ic), 0) AS ic, CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS icir FROM series GROUP BY 1),
every AS (SELECT unnest([{', '.join(f"'{n}'" for n in _ALL)}]) AS feature), scored AS (SELECT feature, coalesce(ic, 0) AS ic, coalesce(icir, 0) AS icir FROM every LEFT JOIN scores USING (feature))"""


def numbers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """(the whole matrix as numbers to six digits, its names).

    Families are written one after the other as codes of 32 bits, in buckets of their rows' key. Composites have a row for every row of the matrix, so the
    others are joined to theirs, bucket by bucket: no column is dealt again, and the joined rows are not stored.
    """
    parts = matrix.parts_of(derived.bars(spark, sf_dir), derived.fundamentals(spark, sf_dir))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.concat_ws("|", F.unix_micros("date").cast("string"), "ticker").alias("row")
    stored = [keyed_part(with_six_digit_codes(df.select(key, *names), names), "row", buckets) for df, names in parts]
    whole = stored[-1]
    for part in stored[:-1]:
        whole = whole.join(part.hint("merge"), "row", "left")
    names = [n for _, own in parts for n in own]
    return from_six_digit_codes(whole.select(*names), names), names


def scored(spark: SparkSession, sf_dir: str, count_rows: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(feature, ic, icir) of every feature of the whole matrix, and with ``count_rows`` (feature, null_fraction): families meet forward returns where they are made and are not joined to each other.

    They are scored one after the other, each leaving a row a feature and date, so disk holds the values of one family at a time, as codes of half their size.
    """
    parts = matrix.parts_of(derived.bars(spark, sf_dir), derived.fundamentals(spark, sf_dir), horizon=4)
    series = None
    for df, names in parts:
        own = cut(research.wide_ic_series([(with_six_digit_codes(df.select("date", "fwd", *names), names), names)]))
        series = own if series is None else series.unionByName(own)
    every = spark.createDataFrame([(n,) for _, names in parts for n in names], "feature string")
    held = series.groupBy("feature").agg(F.sum("held").alias("held"), F.sum("rows").alias("rows"))
    most = held.agg(F.max("rows").alias("most"))  # composites have a row for every row of the matrix
    nulls = every.join(held, "feature", "left").crossJoin(most).select("feature", (1 - F.coalesce("held", F.lit(0)) / F.col("most")).alias("null_fraction"))
    return research.ic_icir(series, every), nulls if count_rows else None


@registry.add(f"WITH RECURSIVE {_SCORED} SELECT feature, {six('ic', 'ic')}, {six('icir', 'icir')} FROM scored")
def ic_icir_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, ic, icir) of every feature of the whole matrix, in one job; features without a value have 0."""
    return scored(spark, sf_dir)[0].select("feature", six_digits(F.col("ic")).alias("ic"), six_digits(F.col("icir")).alias("icir"))


@registry.add(f"""WITH RECURSIVE {_SCORED}, nulls AS (SELECT unnest([{', '.join(f"{{'feature': '{n}', 'null_fraction': avg(({n} IS NULL)::INT)}}" for n in _ALL)}], recursive := true) FROM features)
  SELECT feature, {six('null_fraction', 'null_fraction')}, abs(ic) >= 0.02 AND abs(icir) >= 0.1 AND null_fraction <= 0.3 AS passed FROM nulls JOIN scored USING (feature)""")
def validation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, null_fraction, passed) of every feature of the whole matrix."""
    made = research.validation_summary(*scored(spark, sf_dir, count_rows=True), least_icir=0.1)
    return made.select("feature", six_digits(F.col("null_fraction")).alias("null_fraction"), "passed")


@registry.add()
def redundant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, max_corr): features of the whole matrix that copy an earlier one; correlations of all pairs by blocks of rows."""
    whole, names = numbers(spark, sf_dir)
    return research.redundant_features(research.corr_matrix(whole, names)).select("feature", six_digits(F.col("max_corr")).alias("max_corr"))


@registry.add(f"""WITH RECURSIVE {_CTES}, features AS (SELECT ticker, {', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in _COMPOSITES)} FROM composites), long AS (UNPIVOT features ON {', '.join(_COMPOSITES)} INTO NAME feature VALUE value)
  SELECT feature, ticker, count(*) AS n, {six('min(value)', 'lo')}, {six('max(value)', 'hi')}, {six('avg(value)', 'mean')} FROM long GROUP BY 1, 2""")
def features_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, fundamentals = derived.bars(spark, sf_dir), cut(derived.fundamentals(spark, sf_dir))
    rows, names = matrix.composites(matrix.plans(bars, fundamentals, matrix.staged(bars)))
    return matrix.shown(matrix.wide_sums(rows.select("ticker", *names).repartition("ticker"), names, "ticker"))


@registry.add(f"WITH {BARS} SELECT date, ticker, {six('open', 'open')}, {six('high', 'high')}, {six('low', 'low')}, {six('close', 'close')}, volume FROM bars")
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derived.bars(spark, sf_dir)
    return made.select("date", "ticker", *[six_digits(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], "volume")


@registry.add(f"WITH {BARS}, {GRID} SELECT ticker, count(*) AS n_dates, count(adj_close) AS n_held, {six('sum(returns)', 'sum_returns')} FROM dense GROUP BY 1")
def panel_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = matrix.dense(derived.bars(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("n_dates"), F.count("adj_close").alias("n_held"), F.sum("returns").alias("r"))
    return made.select("ticker", "n_dates", "n_held", six_digits(F.col("r")).alias("sum_returns"))


@registry.add(f"WITH {BARS}, {GRID}, {FUNDAMENTALS}, {ASOF} SELECT date, ticker, {six('pe_ratio', 'pe_ratio')}, {six('roe', 'roe')}, sector FROM asof_panel WHERE adj_close IS NOT NULL")
def asof_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = P.asof_fundamentals(matrix.dense(derived.bars(spark, sf_dir)), derived.fundamentals(spark, sf_dir)).where("adj_close is not null")
    return made.select("date", "ticker", six_digits(F.col("pe_ratio")).alias("pe_ratio"), six_digits(F.col("roe")).alias("roe"), "sector")
