"""Values of some columns of every feature family by (date, ticker), against SQL written by hand from their formulas.

The digests of ``features`` compare all columns with SQL made from the same layers; a wrong formula would be wrong on both
sides there. Here each side states the formula in its own words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorlake.functions.scalar import with_six_digits
from factorlake.functions.staging import cut
from factorlake.operators import panel as P
from factorlake.plans import features as families
from factorlake.plans import matrix
from factorlake.sources import derived

from .base import ASOF, BARS, FUNDAMENTALS, GRID, Registry, six

registry = Registry()


def values(parts: list[tuple[DataFrame, list[str]]], wanted: list[str]) -> DataFrame:
    """The wanted columns of some feature groups, to six significant digits."""
    own = [(df, [n for n in names if n in wanted]) for df, names in parts]
    return with_six_digits(P.join_features_outer(own).select("date", "ticker", *wanted), wanted)


def selected(columns: dict[str, str]) -> str:
    """Columns of the last SELECT, to six significant digits, null where a window has too few values."""
    return ", ".join(f"CASE WHEN {sql} IS NOT NULL THEN {six(sql, '').removesuffix(' AS ')} END AS {name}" for name, sql in columns.items())


def last(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_PRICE = {
    "mom_20d": "r20", "mom_12_1": "(r252 - r21)", "mom_accel_5_20": "(r5 - r20)", "dist_52w_high": "(CASE WHEN n252 >= 63 THEN c / (max252 + 1e-8) - 1 END)",
    "drawdown_60d": "(CASE WHEN n60 >= 30 THEN (c - max60) / (max60 + 1e-8) END)", "sma_cross_10_20": "(CASE WHEN n20 = 20 THEN avg10 / (avg20 + 1e-8) - 1 END)", "mom_consist_20": "(CASE WHEN pos >= 10 THEN rises20 END)",
    "rel_strength_20d": "(r20 - r20_mean)", "mom_zscore_20d": "((r20 - r20_mean) / nullif(r20_sd, 0))", "vol_20d": "(CASE WHEN nr20 >= 10 THEN sd20 * sqrt(252) END)",
    "downside_dev_20d": "(CASE WHEN nr20 >= 10 THEN down20 * sqrt(252) END)", "beta_60d": "(CASE WHEN nr60 >= 30 AND nm60 >= 30 THEN cov60 / (mvar60 + 1e-10) END)", "parkinson_vol_20d": "(CASE WHEN n20 >= 10 THEN sqrt(hl20 / (4 * ln(2.0))) * sqrt(252) END)",
    "atr_14d": "(CASE WHEN ntr14 >= 7 THEN tr14 / (c + 1e-8) END)", "vwap_dev_20d": "(CASE WHEN n20 >= 10 THEN c / (pv20 / (v20 + 1e-8) + 1e-8) - 1 END)", "abnorm_vol_20d": "(CASE WHEN n20 >= 10 THEN volume / (v20 / n20 + 1e-8) END)",
    "dollar_vol_20d": "(CASE WHEN n20 >= 10 THEN ln(1 + pv20 / n20) END)", "amihud_20d": "(CASE WHEN nr20 >= 10 THEN ill20 * 1e6 END)", "rsi_14": "(CASE WHEN nr14 >= 7 THEN 100 - 100 / (1 + gain14 / (loss14 + 1e-8)) END)",
    "bb_pos_20": "(CASE WHEN n20 >= 10 THEN (c - (avg20 - 2 * csd20)) / (4 * csd20 + 1e-8) END)", "stoch_k_14": "(CASE WHEN n14 >= 7 THEN 100 * (c - low14) / (high14 - low14 + 1e-8) END)",
    "williams_r_14": "(CASE WHEN n14 >= 7 THEN -100 * (high14 - c) / (high14 - low14 + 1e-8) END)", "roc_osc_9": "(100 * (c - c9) / (c9 + 1e-8))",
}


@registry.add(f"""WITH {BARS}, {GRID},
  steps AS (SELECT date, ticker, adj_close AS c, volume, high, low, returns, row_number() OVER t AS pos, lag(adj_close) OVER t AS c1, lag(adj_close, 9) OVER t AS c9, adj_close - lag(adj_close) OVER t AS move,
    {', '.join(f'adj_close / nullif(lag(adj_close, {n}) OVER t, 0) - 1 AS r{n}' for n in (5, 20, 21, 252))}, avg(returns) OVER (PARTITION BY date) AS mkt FROM dense WINDOW t AS (PARTITION BY ticker ORDER BY date)),
  ranged AS (SELECT *, CASE WHEN c1 IS NOT NULL AND high IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr FROM steps),
  rolled AS (SELECT *, {', '.join(f'count(c) {last(n)} AS n{n}' for n in (14, 20, 60, 252))}, count(move) {last(14)} AS nr14, count(returns) {last(20)} AS nr20, count(returns) {last(60)} AS nr60, count(mkt) {last(60)} AS nm60,
    max(c) {last(252)} AS max252, max(c) {last(60)} AS max60, avg(c) {last(10)} AS avg10, avg(c) {last(20)} AS avg20, stddev_samp(c) {last(20)} AS csd20,
    avg(CASE WHEN returns > 0 THEN 1.0 ELSE 0.0 END) {last(20)} AS rises20, stddev_samp(returns) {last(20)} AS sd20, stddev_samp(CASE WHEN returns > 0 THEN 0 ELSE returns END) {last(20)} AS down20,
    covar_samp(returns, mkt) {last(60)} AS cov60, var_samp(mkt) {last(60)} AS mvar60, avg(power(ln(high / (low + 1e-8)), 2)) {last(20)} AS hl20, count(tr) {last(14)} AS ntr14, avg(tr) {last(14)} AS tr14,
    sum(c * volume) {last(20)} AS pv20, sum(volume) {last(20)} AS v20, avg(abs(returns) / nullif(c * volume, 0)) {last(20)} AS ill20,
    avg(CASE WHEN move < 0 THEN 0 ELSE move END) {last(14)} AS gain14, -avg(CASE WHEN move > 0 THEN 0 ELSE move END) {last(14)} AS loss14, max(high) {last(14)} AS high14, min(low) {last(14)} AS low14,
    avg(r20) OVER (PARTITION BY date) AS r20_mean, stddev_samp(r20) OVER (PARTITION BY date) AS r20_sd FROM ranged)
  SELECT date, ticker, {selected(_PRICE)} FROM rolled WHERE c IS NOT NULL""")
def feature_rows_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, volatility, volume and technical columns on one panel."""
    grid = matrix.staged(derived.bars(spark, sf_dir).drop("open", "close"))
    made = [families.momentum(), families.volatility(), families.volume(), families.technical()]
    return with_six_digits(matrix.together(grid, made, list(_PRICE)), list(_PRICE))


def percent_rank_sql(x: str) -> str:
    """Average rank of ties over the number of values, by date."""
    return f"(CASE WHEN {x} IS NOT NULL THEN ((rank() OVER (PARTITION BY date, {x} IS NULL ORDER BY {x})) + ((count(*) OVER (PARTITION BY date, {x})) - 1) / 2.0) / (count({x}) OVER (PARTITION BY date)) END)"


_KNOWN = {
    "raw_pe_ratio": "pe_ratio", "inv_pe_ratio": "(1 / nullif(pe_ratio, 0))", "rank_pe_ratio": "(1 - pr_pe)", "rank_earnings_yield": "pr_ey", "zscore_pe_ratio": "z_pe", "yield_composite": "((earnings_yield + dividend_yield) / 2)",
    "debt_adj_ey": "(earnings_yield / (1 + greatest(debt_equity, 0)))", "net_ey": "(earnings_yield - 0.05 * least(greatest(debt_equity, 0), 3))", "roe_pb_ratio": "(roe / nullif(pb_ratio, 0))", "delta_pe_ratio_63d": "(pe_ratio / nullif(pe63, 0) - 1)",
    "value_quality_combo": "((pr_ey + pr_roe) / 2)", "macro_regime_proxy": "spread", "inst_flow_proxy": "(CASE WHEN n5 >= 3 AND n60 >= 30 THEN dv5 / (dv60 + 1e-8) - 1 END)", "is_january": "(CASE WHEN month(date) = 1 THEN 1.0 ELSE 0.0 END)",
    "iv_proxy_short": "(CASE WHEN nr10 >= 5 THEN rv10 * sqrt(252) END)",
}


@registry.add(f"""WITH {BARS}, {GRID}, {FUNDAMENTALS}, {ASOF},
  traded AS (SELECT *, lag(pe_ratio, 63) OVER (PARTITION BY ticker ORDER BY date) AS pe63, stddev_samp(returns) OVER (PARTITION BY date) AS spread, stddev_samp(returns) {last(10)} AS rv10, count(returns) {last(10)} AS nr10,
    avg(adj_close * volume) {last(5)} AS dv5, avg(adj_close * volume) {last(60)} AS dv60, count(adj_close * volume) {last(5)} AS n5, count(adj_close * volume) {last(60)} AS n60,
    {percent_rank_sql('pe_ratio')} AS pr_pe, {percent_rank_sql('earnings_yield')} AS pr_ey, {percent_rank_sql('roe')} AS pr_roe,
    (pe_ratio - avg(pe_ratio) OVER (PARTITION BY date)) / nullif(stddev_samp(pe_ratio) OVER (PARTITION BY date), 0) AS z_pe FROM asof_panel)
  SELECT date, ticker, {selected(_KNOWN)} FROM traded WHERE adj_close IS NOT NULL""")
def feature_rows_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and alternative columns on the panel with fundamentals as of each date."""
    bars, fundamentals = derived.bars(spark, sf_dir).select("date", "ticker", "volume", "adj_close"), derived.fundamentals(spark, sf_dir)
    panel = P.asof_fundamentals(matrix.dense(bars), fundamentals)
    return with_six_digits(matrix.together(panel, [families.value(), families.alternative()], list(_KNOWN)), list(_KNOWN))


_LAGS = {"roa": 4, "debt_equity": 4, "current_ratio": 4, "gross_margin": 4, "roe": 4}
_YES = lambda condition: f"(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"
_REPORT = {
    "qual_roe": "roe", "rank_roe": "pr_roe", "accruals_rank": "(1 - pr_accruals)", "zscore_accruals": "z_accruals", "roe_trend_4q": "(roe - roe_4)", "gm_trend_4q": "(gross_margin - gross_margin_4)", "ey_std_4q": "(CASE WHEN ney4 >= 2 THEN sdey4 END)",
    "quality_leverage_adj": "(roe / (1 + greatest(debt_equity, 0)))", "low_accruals": _YES("accruals < accruals_q"), "quality_accrual_adj": "((pr_roe + 1 - pr_accruals) / 2)",
    "piotroski_f": "(" + " + ".join(map(_YES, ("roa > 0", "roa > roa_4", "roa > accruals", "accruals < 0", "debt_equity < debt_equity_4", "debt_equity < de_q", "current_ratio > current_ratio_4", "current_ratio > 1", "gross_margin > gross_margin_4"))) + ")",
}


@registry.add(f"""WITH {FUNDAMENTALS},
  reported AS (SELECT d.date, t.ticker, f.* EXCLUDE (date, ticker), f.date IS NOT NULL AS held FROM (SELECT DISTINCT date FROM fundamentals) d CROSS JOIN (SELECT DISTINCT ticker FROM fundamentals) t LEFT JOIN fundamentals f ON f.date = d.date AND f.ticker = t.ticker),
  compared AS (SELECT *, {', '.join(f'lag({c}, {n}) OVER (PARTITION BY ticker ORDER BY date) AS {c}_{n}' for c, n in _LAGS.items())}, count(earnings_yield) {last(4)} AS ney4, stddev_samp(earnings_yield) {last(4)} AS sdey4,
    {percent_rank_sql('roe')} AS pr_roe, {percent_rank_sql('accruals')} AS pr_accruals, quantile_cont(accruals, 0.3) OVER (PARTITION BY date) AS accruals_q, quantile_cont(debt_equity, 0.4) OVER (PARTITION BY date) AS de_q,
    (accruals - avg(accruals) OVER (PARTITION BY date)) / nullif(stddev_samp(accruals) OVER (PARTITION BY date), 0) AS z_accruals FROM reported)
  SELECT date, ticker, {selected(_REPORT)} FROM compared WHERE held""")
def feature_rows_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality columns on the grid of report dates."""
    return values([matrix.quality(cut(derived.fundamentals(spark, sf_dir)))], list(_REPORT))
