"""Queries of costs, ledgers, performance, risk, attribution, causal checks, regimes, forecasts and graphs on weekly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.staging import cut
from factorlake.operators import causal, graph, regime, risk
from factorlake.sources import derived
from factorlake.streaming import state

from .base import FUNDAMENTALS, Registry, six
from .research import SMALL, shown, small

registry = Registry()

STRATEGY = f"""{SMALL}, held AS (SELECT 's1' AS strategy, ticker, date, sign(ret5) * 0.01 AS signal, close, volume, returns,
  avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS adv,
  close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS ch FROM small),
strategy AS (SELECT strategy, ticker, date, coalesce(signal, 0) AS signal, close, volume, returns, adv, coalesce(stddev_samp(ch) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0) / 100 AS volatility,
  row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM held)"""
LEDGER = f"""{STRATEGY}, smooth AS (SELECT ticker, date, pos, signal, adv, 0.02::DOUBLE AS volatility, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS close FROM strategy),
ledger AS (SELECT ticker, date, pos, signal, 0.0::DOUBLE AS shares, 1e2::DOUBLE AS cash, 1e2::DOUBLE AS value, 0.0::DOUBLE AS cost FROM smooth WHERE pos = 1
  UNION ALL SELECT ticker, date, pos, signal, target, cash2, cash2 + target * close, cost FROM (
    SELECT *, cash - q * close - cost AS cash2 FROM (SELECT *, CASE WHEN q = 0 OR adv <= 0 THEN 0 ELSE abs(q) * ((0.0010 / 2 + 0.0005) * close + volatility * sqrt(abs(q) / adv) * close) END AS cost FROM (
      SELECT *, target - shares AS q FROM (SELECT n.ticker, n.date, n.pos, n.signal, n.close, n.adv, n.volatility, l.cash, l.shares,
        (l.cash + l.shares * n.close) * least(greatest(l.signal, -1), 1) / n.close AS target FROM ledger l JOIN smooth n ON n.ticker = l.ticker AND n.pos = l.pos + 1)))))"""


def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.rolling_vol30(risk.rolling_adv(small(spark, sf_dir)))
    return rows.select(F.lit("s1").alias("strategy"), "ticker", "date", F.coalesce(F.signum("ret5") * 0.01, F.lit(0.0)).alias("signal"), "close", "volume", "returns", "adv", "volatility")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale prices jump a hundredfold from week to week, which no ledger survives; so it runs on their 60-week means."""
    smooth = F.expr("avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
    return risk.position_ledger(strategy(spark, sf_dir).withColumn("close", smooth).withColumn("volatility", F.lit(0.02)), capital=1e2)


_COST = "CASE WHEN volume = 0 OR adv <= 0 THEN 0 ELSE volume / 10 * ((0.0010 / 2 + 0.0005) * close + volatility * sqrt(volume / 10 / adv) * close) END"


@registry.add(f"WITH {STRATEGY} SELECT ticker, {six('sum(' + _COST + ')', 'cost')}, {six('max(adv)', 'adv')}, {six('max(volatility)', 'volatility')} FROM strategy GROUP BY 1")
def transaction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = risk.transaction_cost(F.col("volume") / 10, F.col("adv"), F.col("volatility"), F.col("close"))
    made = strategy(spark, sf_dir).withColumn("cost", cost).groupBy("ticker").agg(F.sum("cost").alias("cost"), F.max("adv").alias("adv"), F.max("volatility").alias("volatility"))
    return shown(made, "cost", "adv", "volatility")


@registry.add(f"WITH RECURSIVE {LEDGER} SELECT ticker, count(*) AS n, {six('arg_max(value, date)', 'value')}, {six('sum(cost)', 'cost')} FROM ledger GROUP BY 1")
def position_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ledger(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n"), F.max_by("value", "date").alias("value"), F.sum("cost").alias("cost"))
    return shown(made, "value", "cost")


@registry.add(f"""WITH {STRATEGY}, v AS (SELECT ticker, date, close AS value, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r, close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM strategy)
  SELECT ticker, count(*) AS n, {six('arg_max(value, date) / arg_min(value, date) - 1', 'total_return')}, {six('avg(r) / stddev_samp(r) * sqrt(252)', 'sharpe')}, {six('min(dd)', 'max_drawdown')},
  {six('CASE WHEN min(dd) < -1e-12 THEN avg(r) * 252 / -min(dd) ELSE 0 END', 'calmar')}, {six('avg(r) / stddev_pop(r) * sqrt(252)', 'information_ratio')} FROM v GROUP BY 1""")
def perf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = risk.perf_metrics(strategy(spark, sf_dir).select("ticker", "date", F.col("close").alias("value")), ["ticker"])
    return shown(made, "total_return", "sharpe", "max_drawdown", "calmar", "information_ratio")


@registry.add(f"""WITH {SMALL}, {FUNDAMENTALS}, dl AS (SELECT ticker, max(date)::DATE AS delist_date FROM small WHERE CAST(ticker AS INT) % 5 = 0 AND date < TIMESTAMP '2000-06-01' GROUP BY 1)
  SELECT s.ticker, count(*) AS n, {six('arg_max(CASE WHEN s.date::DATE = delist_date THEN close * 0.7 ELSE close END, s.date)', 'last_close')} FROM small s LEFT JOIN dl ON dl.ticker = s.ticker WHERE delist_date IS NULL OR s.date::DATE <= delist_date GROUP BY 1""")
def survivorship_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = small(spark, sf_dir)
    gone = panel.where((F.col("ticker").cast("int") % 5 == 0) & (F.col("date") < F.lit("2000-06-01").cast("timestamp"))).groupBy("ticker").agg(F.to_date(F.max("date")).alias("delist_date"))
    made = risk.survivorship_adjust(panel, gone).groupBy("ticker").agg(F.count("*").alias("n"), F.max_by("close", "date").alias("last_close"))
    return shown(made, "last_close")


_PNL = f"""{SMALL}, w AS (SELECT p.p AS portfolio, t.ticker, 1.0 / (1 + (CAST(t.ticker AS INT) * (p.p + 3)) % 7) AS raw FROM range(0, 5) p(p), (SELECT DISTINCT ticker FROM small) t),
weights AS (SELECT portfolio, ticker, raw / sum(raw) OVER (PARTITION BY portfolio) AS weight FROM w),
pnl AS (SELECT portfolio, date, sum(returns * weight) AS pnl FROM small JOIN weights USING (ticker) WHERE returns IS NOT NULL GROUP BY 1, 2)"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small panel, computed once for queries that use it several times."""
    return cut(small(spark, sf_dir))


def weights(spark: SparkSession, panel: DataFrame) -> DataFrame:
    raw = 1.0 / (1 + (F.col("ticker").cast("int") * (F.col("portfolio") + 3)) % 7)
    rows = panel.select("ticker").distinct().crossJoin(spark.range(5).withColumnRenamed("id", "portfolio")).withColumn("weight", raw)
    return risk.weight_clip_normalise(rows, 2.0).select("portfolio", "ticker", "weight")


def pnl(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    panel = (panel or staged(spark, sf_dir)).where("returns is not null")
    return risk.scenario_pnl(panel.select("date", "ticker", F.col("returns").alias("r")), weights(spark, panel))


@registry.add(f"WITH {_PNL} SELECT portfolio, date, {six('pnl', 'pnl')} FROM pnl")
def scenario_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pnl(spark, sf_dir), "pnl")


_VAR = f"{_PNL}, v AS (SELECT portfolio, quantile_cont(pnl, 0.05) AS var FROM pnl GROUP BY 1), cvar AS (SELECT portfolio, max(var) AS var, -avg(pnl) FILTER (pnl <= var) AS cvar FROM pnl JOIN v USING (portfolio) GROUP BY 1)"


@registry.add(f"WITH {_VAR} SELECT portfolio, {six('var', 'var')}, {six('cvar', 'cvar')} FROM cvar")
def empirical_var_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(risk.empirical_var_cvar(cut(pnl(spark, sf_dir))), "var", "cvar")


@registry.add(f"""WITH {_PNL}, g AS (SELECT a.portfolio, -a.pnl AS g, -a.pnl + sum(greatest(-b.pnl + a.pnl, 0)) / (0.05 * count(*)) AS v FROM pnl a JOIN pnl b ON b.portfolio = a.portfolio GROUP BY a.portfolio, a.date, a.pnl)
  SELECT portfolio, {six('min(v)', 'cvar')} FROM g GROUP BY 1""")
def ru_cvar_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(risk.ru_cvar(pnl(spark, sf_dir)), "cvar")


_CHECK = f"""{_VAR}, mu AS (SELECT ticker, avg(returns) AS mu FROM small GROUP BY 1),
checked AS (SELECT portfolio, sum(weight) AS total, sum(weight * coalesce(mu, 0)) AS mu, max(cvar) AS cvar, max(weight) AS high, min(weight) AS low FROM weights JOIN mu USING (ticker) JOIN cvar USING (portfolio) GROUP BY 1),
flags AS (SELECT *, cvar <= 0.2 AND mu >= 0 AND total BETWEEN 0.9 AND 1.1 AND low >= 0 AND high <= 0.2 + 1e-12 AS feasible FROM checked)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = staged(spark, sf_dir)
    mu = panel.groupBy("ticker").agg(F.avg("returns").alias("mu"))
    return risk.constraint_check(weights(spark, panel.where("returns is not null")), mu, risk.empirical_var_cvar(cut(pnl(spark, sf_dir, panel))).select("portfolio", "cvar"), most_cvar=0.2)


@registry.add(f"WITH {_CHECK} SELECT portfolio, {six('total', 'total')}, {six('mu', 'mu')}, {six('cvar', 'cvar')}, feasible FROM flags")
def constraint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(checked(spark, sf_dir).select("portfolio", "total", "mu", "cvar", "feasible"), "total", "mu", "cvar")


@registry.add(f"WITH {_CHECK} SELECT portfolio, {six('cvar', 'cvar')}, {six('mu', 'mu')} FROM flags WHERE feasible ORDER BY cvar, portfolio LIMIT 1")
def candidate_portfolio_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(risk.candidate_portfolio_search(checked(spark, sf_dir)), "cvar", "mu")


@registry.add(f"WITH {_PNL}, c AS (SELECT portfolio, ticker, least(weight, 0.012) AS weight FROM weights) SELECT portfolio, ticker, {six('weight / sum(weight) OVER (PARTITION BY portfolio)', 'weight')} FROM c")
def weight_clip_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = small(spark, sf_dir).where("returns is not null")
    return shown(risk.weight_clip_normalise(weights(spark, panel), 0.012), "weight")


_SEGMENTS = f"""{SMALL}, {FUNDAMENTALS}, sides AS (SELECT sector AS segment, sum(volume) AS v, avg(returns) AS r, (CAST(s.ticker AS INT) % 2 = 0) AS own FROM small s JOIN (SELECT DISTINCT ticker, sector FROM fundamentals) f USING (ticker) GROUP BY 1, 4),
p AS (SELECT segment, v / sum(v) OVER () AS wp, r AS rp FROM sides WHERE own), b AS (SELECT segment, v / sum(v) OVER () AS wb, r AS rb FROM sides WHERE NOT own),
j AS (SELECT coalesce(p.segment, b.segment) AS segment, coalesce(wp, 0) AS wp, coalesce(rp, 0) AS rp, coalesce(wb, 0) AS wb, coalesce(rb, 0) AS rb, (SELECT sum(wb * rb) FROM b) AS rt FROM p FULL JOIN b ON b.segment = p.segment),
a AS (SELECT segment, (wp - wb) * (rb - rt) AS allocation, wb * (rp - rb) AS selection, (wp - wb) * (rp - rb) AS interaction FROM j)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sector = derived.fundamentals(spark, sf_dir).select("ticker", "sector").distinct()
    rows = small(spark, sf_dir).join(sector, "ticker").withColumn("own", F.col("ticker").cast("int") % 2 == 0)
    sums = rows.groupBy(F.col("sector").alias("segment"), "own").agg(F.sum("volume").alias("v"), F.avg("returns").alias("r"))

    def side(own: bool) -> DataFrame:
        part = sums.where(F.col("own") == own)
        return part.crossJoin(part.agg(F.sum("v").alias("all"))).select("segment", (F.col("v") / F.col("all")).alias("weight"), "r")

    return side(True), side(False)


@registry.add(f"WITH {_SEGMENTS} SELECT coalesce(segment, 'TOTAL') AS segment, {six('sum(allocation)', 'allocation')}, {six('sum(selection)', 'selection')}, {six('sum(interaction)', 'interaction')}, {six('sum(allocation) + sum(selection) + sum(interaction)', 'total')} FROM a GROUP BY ROLLUP (segment)")
def brinson_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(risk.brinson_attribution(*sides(spark, sf_dir)), "allocation", "selection", "interaction", "total")


@registry.add()
def candidate_weights_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 64 random weight vectors over all tickers."""
    panel = staged(spark, sf_dir)
    drawn = cut(risk.candidate_weights(panel.select("ticker").distinct(), 64))
    gains = cut(risk.scenario_pnl(panel.where("returns is not null").select("date", "ticker", F.col("returns").alias("r")), drawn))
    mu = panel.groupBy("ticker").agg(F.avg("returns").alias("mu"))
    found = risk.constraint_check(drawn, mu, risk.empirical_var_cvar(gains).select("portfolio", "cvar"), most_cvar=0.2)
    return shown(risk.candidate_portfolio_search(found), "cvar", "mu")


@registry.add(f"""WITH {SMALL}, {FUNDAMENTALS}, u AS (SELECT sector AS universe, ticker, date, returns AS r FROM small JOIN (SELECT DISTINCT ticker, sector FROM fundamentals) USING (ticker) WHERE returns IS NOT NULL),
  t AS (SELECT universe, ticker, row_number() OVER (PARTITION BY universe ORDER BY ticker) AS k FROM (SELECT DISTINCT universe, ticker FROM u)), ut AS (SELECT * FROM u JOIN t USING (universe, ticker)),
  vs AS (SELECT a.universe, a.date, a.r - b.r AS v FROM ut a JOIN ut b ON b.universe = a.universe AND b.date = a.date AND a.k = 1 AND b.k = 2), vv AS (SELECT universe, var_samp(v) AS vv FROM vs GROUP BY 1),
  pi AS (SELECT universe, ticker, k, avg(r) AS pi FROM ut GROUP BY 1, 2, 3), gap AS (SELECT universe, 0.01 - sum(CASE k WHEN 1 THEN pi ELSE -pi END) AS gap FROM pi WHERE k <= 2 GROUP BY 1),
  c AS (SELECT u.universe, u.ticker, covar_samp(r, v) AS c FROM u JOIN vs ON vs.universe = u.universe AND vs.date = u.date GROUP BY 1, 2)
  SELECT pi.universe, pi.ticker, {six('pi + coalesce(0.05 * c / (0.05 * vv + 0.02) * gap, 0)', 'mu')} FROM pi LEFT JOIN c ON c.universe = pi.universe AND c.ticker = pi.ticker LEFT JOIN vv ON vv.universe = pi.universe LEFT JOIN gap ON gap.universe = pi.universe""")
def bl_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior means by sector: the tickers of a sector are a universe, with one view that the first beats the second."""
    from pyspark.sql import Window

    sector = derived.fundamentals(spark, sf_dir).select("ticker", F.col("sector").alias("universe")).distinct()
    rows = cut(small(spark, sf_dir).where("returns is not null").join(sector, "ticker").select("universe", "ticker", "date", F.col("returns").alias("r")))
    first = rows.select("universe", "ticker").distinct().withColumn("k", F.row_number().over(Window.partitionBy("universe").orderBy("ticker"))).where("k <= 2")
    pairs = first.withColumn("n", F.count("*").over(Window.partitionBy("universe"))).where("n = 2")
    views = pairs.select("universe", F.lit("first").alias("view"), "ticker", F.when(F.col("k") == 1, 1.0).otherwise(-1.0).alias("p"))
    quotes = pairs.where("k = 1").select("universe", F.lit("first").alias("view"), F.lit(0.01).alias("q"), F.lit(0.02).alias("omega"))
    return shown(risk.bl_update(rows, views, quotes), "mu")


# causal checks

VARIABLES = ["ret5", "ret20", "vol20", "fwd"]
_R = {(a, b): f"corr({a}, {b})" for i, a in enumerate(VARIABLES) for b in VARIABLES[i + 1 :]}
_WHOLE = f"{SMALL}, whole AS (SELECT * FROM small WHERE {' AND '.join(f'{v} IS NOT NULL' for v in VARIABLES)})"
_PAIR = f"{_WHOLE}, one AS (" + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, {r} AS r, count(*) AS n FROM whole" for (a, b), r in _R.items()) + "), pair AS (SELECT * FROM one UNION ALL SELECT j, i, r, n FROM one)"
_PARTIAL = "partial AS (SELECT p.i, p.j, a.j AS k, (p.r - a.r * b.r) / nullif(sqrt((1 - a.r * a.r) * (1 - b.r * b.r)), 0) AS r, p.n FROM pair p JOIN pair a ON a.i = p.i AND a.j <> p.j JOIN pair b ON b.i = p.j AND b.j = a.j WHERE p.i < p.j)"
_CDF = "CASE WHEN {z} >= 0 THEN 0.5 * (1 + {e}) ELSE 0.5 * (1 - {e}) END"


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    return _CDF.format(z=z, e=f"(1 - {poly} * exp(-({z}) * ({z}) / 2))")


def p_sql(z: str) -> str:
    return f"(2 * (1 - ({cdf_sql(f'abs({z})')})))"


_Z = "(0.5 * ln((1 + least(greatest(r, -0.999999), 0.999999)) / (1 - least(greatest(r, -0.999999), 0.999999))) * sqrt(greatest(n - {q} - 3, 1)))"


@registry.add(f"WITH {_PAIR}, {_PARTIAL} SELECT i, j, k, {six('r', 'r')}, n FROM partial")
def partial_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(causal.partial_corr(causal.pair_correlations(small(spark, sf_dir), VARIABLES)), "r")


@registry.add(f"WITH {_PAIR}, t AS (SELECT i, j, {_Z.format(q=0)} AS z FROM pair WHERE i < j) SELECT i, j, round({p_sql('z')}, 5) + 0.0 AS p FROM t")
def fisher_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = causal.pair_correlations(small(spark, sf_dir), VARIABLES).where("i < j")
    return made.select("i", "j", (F.round(causal.fisher_z(F.col("r"), F.col("n"), 0), 5) + 0.0).alias("p"))


_SKELETON = f"""{_PAIR}, {_PARTIAL}, tests AS (SELECT i, j, NULL AS k, {p_sql('z')} AS p FROM (SELECT *, {_Z.format(q=0)} AS z FROM pair WHERE i < j) UNION ALL SELECT i, j, k, {p_sql('z')} FROM (SELECT *, {_Z.format(q=1)} AS z FROM partial)),
sep AS (SELECT i, j, arg_min(coalesce(k, ''), coalesce(k, '')) AS k FROM tests WHERE p >= 0.05 GROUP BY 1, 2),
edges AS (SELECT i, j FROM one o WHERE i < j AND NOT EXISTS (SELECT 1 FROM sep s WHERE s.i = o.i AND s.j = o.j) UNION SELECT j, i FROM one o WHERE j < i AND NOT EXISTS (SELECT 1 FROM sep s WHERE s.i = o.j AND s.j = o.i))"""


@registry.add(f"WITH {_SKELETON} SELECT i, j FROM edges")
def ci_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal.ci_skeleton(small(spark, sf_dir), VARIABLES)[0]


@registry.add(f"""WITH {_SKELETON}, adj AS (SELECT i, j FROM edges UNION SELECT j, i FROM edges),
  un AS (SELECT a.i, a.j AS k, b.j FROM adj a JOIN adj b ON b.i = a.j AND a.i < b.j WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.i = a.i AND e.j = b.j) AND NOT EXISTS (SELECT 1 FROM sep s WHERE s.i = a.i AND s.j = b.j AND s.k = a.j AND s.k <> ''))
  SELECT i AS src, k AS dst FROM un UNION SELECT j, k FROM un""")
def orient_colliders(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, sepsets = causal.ci_skeleton(small(spark, sf_dir), VARIABLES)
    return causal.orient_colliders(edges, sepsets)


@registry.add()
def latent_confounder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = staged(spark, sf_dir)
    edges, sepsets = map(cut, causal.ci_skeleton(panel, VARIABLES))
    return causal.latent_confounder_edges(edges, causal.orient_colliders(edges, sepsets), causal.pair_correlations(panel, VARIABLES))


#: Six variables, so that edges keep enough neighbours for sets of two.
MORE = ["close", "fwd", "ret20", "ret5", "vol20", "volume"]
_MORE_ONE = " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, corr({a}, {b}) AS r, count(*) AS n FROM more" for i, a in enumerate(MORE) for b in MORE[i + 1 :])
_DEEPER = f"""{SMALL}, more AS (SELECT * FROM small WHERE {' AND '.join(f'{v} IS NOT NULL' for v in MORE)}),
one AS ({_MORE_ONE}), pair AS (SELECT * FROM one UNION ALL SELECT j, i, r, n FROM one),
p1 AS (SELECT p.i, p.j, a.j AS k, (p.r - a.r * b.r) / sqrt((1 - a.r * a.r) * (1 - b.r * b.r)) AS r, p.n FROM pair p JOIN pair a ON a.i = p.i AND a.j <> p.j JOIN pair b ON b.i = p.j AND b.j = a.j),
p2 AS (SELECT p.i, p.j, p.k, a.j AS l, (p.r - a.r * b.r) / sqrt((1 - a.r * a.r) * (1 - b.r * b.r)) AS r, p.n FROM p1 p JOIN p1 a ON a.i = p.i AND a.k = p.k AND a.j <> p.j JOIN p1 b ON b.i = p.j AND b.k = p.k AND b.j = a.j WHERE p.k < a.j),
e0 AS (SELECT i, j FROM (SELECT *, {_Z.format(q=0)} AS z FROM pair) WHERE {p_sql('z')} < 0.05),
s1 AS (SELECT DISTINCT i, j FROM (SELECT *, {_Z.format(q=1)} AS z FROM p1) t WHERE {p_sql('z')} >= 0.05 AND EXISTS (SELECT 1 FROM e0 WHERE e0.i = t.i AND e0.j = t.k)),
e1 AS (SELECT * FROM e0 WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE (s1.i = e0.i AND s1.j = e0.j) OR (s1.i = e0.j AND s1.j = e0.i))),
s2 AS (SELECT DISTINCT i, j FROM (SELECT *, {_Z.format(q=2)} AS z FROM p2) t WHERE {p_sql('z')} >= 0.05 AND EXISTS (SELECT 1 FROM e1 WHERE e1.i = t.i AND e1.j = t.k) AND EXISTS (SELECT 1 FROM e1 WHERE e1.i = t.i AND e1.j = t.l)),
e2 AS (SELECT * FROM e1 WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE (s2.i = e1.i AND s2.j = e1.j) OR (s2.i = e1.j AND s2.j = e1.i)))"""


@registry.add(f"WITH {_DEEPER} SELECT i, j FROM e2 WHERE i < j")
def ci_skeleton_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal.skeleton(staged(spark, sf_dir), MORE, order=2)[0]


@registry.add(f"WITH {SMALL}, m AS (SELECT quantile_cont(ret20, 0.5) AS m FROM small) SELECT ticker, CAST(sum(CASE WHEN ret20 > m THEN 1 ELSE 0 END) AS DOUBLE) AS treated FROM small, m GROUP BY 1")
def binarise_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = cut(small(spark, sf_dir).select("ticker", "ret20"))  # its median and its rows read it
    return causal.binarise_median(panel, "ret20").groupBy("ticker").agg(F.sum("treatment").alias("treated"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).withColumn("id", F.concat_ws("-", "ticker", F.unix_timestamp("date").cast("string")))


@registry.add()
def dml_ate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of the last five weeks' return on the next four weeks', given volatility, for each ticker."""
    return causal.dml_linear(keyed(spark, sf_dir), "vol20", "ret5", "fwd", group="ticker")


@registry.add(f"""WITH {_WHOLE}, r AS (SELECT CASE WHEN ret5 > 0 THEN 1.0 ELSE 0.0 END AS t, fwd AS y FROM whole), a AS (SELECT avg(t) AS m, avg(y) AS l FROM r), f AS (SELECT (t - m) * (y - l) / (m * (1 - m)) AS f FROM r, a),
  s AS (SELECT avg(f) AS ate, count(*) AS n, var_pop(f) * count(*) AS ss FROM f), e AS (SELECT ate, n, (f - ate) / (1 - least(1.0 / n + power(f - ate, 2) / (ss + 1e-9), 0.99)) AS e FROM f, s)
  SELECT {six('max(ate)', 'ate')}, {six('sqrt(greatest(avg(e * e) / max(n), 1e-12))', 'se')}, max(n) AS n FROM e""")
def hc3_se_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Influence values of a rise over the last five weeks on the next four weeks' return, with the shares and means of all rows as nuisances."""
    rows = staged(spark, sf_dir).dropna(subset=VARIABLES).select((F.col("ret5") > 0).cast("double").alias("t"), F.col("fwd").alias("y"))
    facts = rows.agg(F.avg("t").alias("m"), F.avg("y").alias("l"))
    influence = rows.crossJoin(facts).select(((F.col("t") - F.col("m")) * (F.col("y") - F.col("l")) / (F.col("m") * (1 - F.col("m")))).alias("influence"))  # one row
    return shown(causal.hc3_se_pvalue(influence).select("ate", "se", "n"), "ate", "se")


@registry.add(f"""WITH {_WHOLE}, c AS (SELECT corr(fwd, vol20) AS a, corr(fwd, ret5) AS b, corr(vol20, ret5) AS c FROM whole), d AS (SELECT a * a AS reduced, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS full_r2 FROM c)
  SELECT {six('(full_r2 - reduced) / (1 - reduced)', 'partial_r2')}, CASE WHEN (full_r2 - reduced) / (1 - reduced) >= 0.05 THEN 'ROBUST' ELSE 'FRAGILE' END AS verdict FROM d""")
def partial_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    share, verdict = causal.partial_r2(small(spark, sf_dir).dropna(subset=VARIABLES), ["vol20"], "ret5", "fwd")
    return shown(spark.createDataFrame([(share, verdict)], "partial_r2 double, verdict string"), "partial_r2")


_ROS = f"""{SMALL}, m AS (SELECT quantile_cont(ret20, 0.5) AS m FROM small), t AS (SELECT CASE WHEN ret20 > m THEN 1 ELSE 0 END AS t, fwd FROM small, m WHERE fwd IS NOT NULL),
c AS (SELECT quantile_cont(fwd, 0.5) AS q FROM t WHERE t = 0), u AS (SELECT min(fwd) AS med FROM t, c WHERE t = 0 AND fwd >= q), k AS (SELECT count(*) AS n, sum((fwd > med)::INT) AS above FROM t, u WHERE t = 1),
g AS (SELECT *, CAST(gamma AS DOUBLE) AS gg FROM (VALUES (1.0), (1.5), (2.0)) v(gamma), k)"""
_TAIL = lambda p: f"round(1 - ({cdf_sql(f'((above - n * {p}) / sqrt(n * {p} * (1 - {p})))')}), 5) + 0.0"


@registry.add(f"WITH {_ROS} SELECT gg AS gamma, n, CAST(above AS BIGINT) AS above, {_TAIL('(1 - gg / (1 + gg))')} AS p_low, {_TAIL('(gg / (1 + gg))')} AS p_high FROM g")
def rosenbaum_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = cut(small(spark, sf_dir).select("ret20", "fwd"))
    made = causal.rosenbaum_bounds(causal.binarise_median(panel, "ret20"), "treatment", "fwd", [1.0, 1.5, 2.0])
    return made.select("gamma", "n", "above", *[(F.round(c, 5) + 0.0).alias(c) for c in ("p_low", "p_high")])


# regimes and forecasts


@registry.add(f"WITH {SMALL}, r AS (SELECT ticker, date, returns, stddev_pop(returns) OVER w AS vol, count(returns) OVER w AS k FROM small WHERE returns IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT ticker, count(*) AS n, {six('avg(returns)', 'ret')}, {six('avg(vol)', 'vol')} FROM r WHERE k = 20 GROUP BY 1")
def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = regime.regime_features(small(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), F.avg("vol").alias("vol"))
    return shown(made, "ret", "vol")


_RULE = f"""{SMALL}, r AS (SELECT ticker, date, stddev_pop(returns) OVER w AS s, avg(returns) OVER w AS m, count(returns) OVER w AS k FROM small WHERE returns IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
rule AS (SELECT ticker, date, CASE WHEN k < 5 THEN 'bull' WHEN s * sqrt(252) > 0.25 THEN 'high_vol' WHEN m < -0.0005 THEN 'bear' ELSE 'bull' END AS regime FROM r)"""


@registry.add(f"WITH {_RULE} SELECT regime, count(*) AS n, count(DISTINCT ticker) AS tickers FROM rule GROUP BY 1")
def regime_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.regime_rule(small(spark, sf_dir)).groupBy("regime").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"))


@registry.add(f"WITH {_RULE} SELECT ticker, {six('sum(CASE WHEN regime = $$bull$$ THEN 0.8 ELSE 0.1 END)', 'bull')}, {six('sum(CASE WHEN regime = $$bear$$ THEN 0.8 ELSE 0.1 END)', 'bear')} FROM rule GROUP BY 1")
def regime_probs_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = regime.regime_probs_rule(regime.regime_rule(small(spark, sf_dir))).groupBy("ticker").agg(F.sum(F.col("probs")["bull"]).alias("bull"), F.sum(F.col("probs")["bear"]).alias("bear"))
    return shown(made, "bull", "bear")


@registry.add()
def regime_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.regime_cluster(regime.regime_features(small(spark, sf_dir)))


@registry.add(f"""WITH RECURSIVE {SMALL}, z AS (SELECT ticker, date, (returns - avg(returns) OVER (PARTITION BY ticker)) / stddev_pop(returns) OVER (PARTITION BY ticker) AS z, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM small WHERE returns IS NOT NULL),
  f AS (SELECT ticker, date, pos, greatest(0, z - 0.5) AS up, greatest(0, -z - 0.5) AS down FROM z WHERE pos = 1 AND n >= 10
    UNION ALL SELECT z.ticker, z.date, z.pos, greatest(0, CASE WHEN up > 3 OR down > 3 THEN 0 ELSE up END + z.z - 0.5), greatest(0, CASE WHEN up > 3 OR down > 3 THEN 0 ELSE down END - z.z - 0.5) FROM f JOIN z ON z.ticker = f.ticker AND z.pos = f.pos + 1)
  SELECT ticker, date, CASE WHEN up > 3 THEN 'up' ELSE 'down' END AS side FROM f WHERE up > 3 OR down > 3""")
def cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.cusum(small(spark, sf_dir).select("ticker", "date", F.col("returns").alias("value")).where("value is not null"))


@registry.add(registry.sql["cusum"])
def cusum_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alarms from a stream: a third of the dates a micro-batch, sums kept as state between them."""
    series = cut(small(spark, sf_dir).select("ticker", F.col("date").cast("timestamp").alias("date"), F.col("returns").alias("value")).where("value is not null"))
    limits = cut(state.cusum_limits(series))
    first, last = series.agg(F.min("date"), F.max("date")).first()
    third = (last - first) / 3
    within = [(F.col("date") >= F.lit(first + n * third)) & ((F.col("date") < F.lit(first + (n + 1) * third)) | F.lit(n == 2)) for n in range(3)]
    return state.replay([series.where(w) for w in within], lambda stream: state.cusum_stream(stream, limits))[0]


@registry.add(f"""WITH {STRATEGY}, d AS (SELECT ticker, signal, coalesce(returns, 0) AS ret, coalesce(ln(close / lag(close) OVER w), 0) AS log_change, CASE WHEN count(returns) OVER v = 20 THEN stddev_pop(returns) OVER v ELSE 0 END AS vol FROM strategy
  WINDOW w AS (PARTITION BY ticker ORDER BY date), v AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT ticker, count(*) AS n, {six('sum(abs(log_change))', 'log_change')}, {six('avg(vol)', 'vol')}, {six('sum(abs(ret))', 'ret')} FROM d GROUP BY 1""")
def dl_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = regime.dl_feature_matrix(strategy(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.abs("log_change")).alias("log_change"), F.avg("vol").alias("vol"), F.sum(F.abs("ret")).alias("ret"))
    return shown(made, "log_change", "vol", "ret")


@registry.add(f"""WITH {STRATEGY}, q AS (SELECT ticker, list(signal) OVER w AS x, close AS y FROM strategy WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
  SELECT ticker, count(*) AS n, {six('sum(x[1] + x[12])', 'ends')}, {six('sum(y)', 'y')} FROM q WHERE len(x) = 12 GROUP BY 1""")
def sliding_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = regime.sliding_sequences(strategy(spark, sf_dir), ["signal"], "close", 12)
    ends = made.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("x")[0]["signal"] + F.col("x")[11]["signal"]).alias("ends"), F.sum("y").alias("y"))
    return shown(ends, "ends", "y")


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).select("ticker", "date", F.col("close").alias("value"))


HELD_BACK = 5


def _ends(rows: str) -> str:
    """Tables of the series s from rows (ticker, date, close), with its last two values before each."""
    w = "OVER (PARTITION BY ticker ORDER BY date)"
    return f"s AS (SELECT ticker, date, close AS value, lag(close) {w} AS before, lag(close, 2) {w} AS before2 FROM {rows}), h AS (SELECT unnest([1, {HELD_BACK}]) AS horizon)"


_ENDS = f"{SMALL}, {_ends('small')}"
_FORECASTS = {
    "drift": "SELECT ticker, horizon, last + horizon * (last - first) / n AS forecast FROM (SELECT ticker, arg_min(value, date) AS first, arg_max(value, date) AS last, count(*) AS n FROM s GROUP BY 1), h",
    "ar1": "SELECT ticker, horizon, last * power(rho, horizon) AS forecast FROM (SELECT ticker, arg_max(value, date) AS last, coalesce(corr(value, before), 0) AS rho FROM s GROUP BY 1), h",
    "ols": """SELECT ticker, horizon, CASE WHEN n > 10 THEN ((s22 * t1 - s12 * t2) * x1 + (s11 * t2 - s12 * t1) * x2) / (s11 * s22 - s12 * s12) ELSE 0 END * sqrt(horizon) AS forecast FROM (SELECT ticker, count(*) AS n, sum(before * before) AS s11, sum(before * before2) AS s12,
      sum(before2 * before2) AS s22, sum(before * value) AS t1, sum(before2 * value) AS t2, arg_max(before, date) AS x1, arg_max(before2, date) AS x2 FROM s WHERE before2 IS NOT NULL GROUP BY 1), h""",
}


def ols(series: DataFrame, horizons: list[int]) -> DataFrame:
    """Least squares on the two values before."""
    w = regime.by_date()
    return regime.forecast_ols(series.withColumns({"before": F.lag("value").over(w), "before2": F.lag("value", 2).over(w)}), ["before", "before2"], "value", horizons)


@registry.add(f"WITH {_ENDS} SELECT ticker, horizon, {six('forecast', 'forecast')} FROM ({_FORECASTS['drift']})")
def forecast_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(regime.forecast_drift(closes(spark, sf_dir), [1, 5]), "forecast")


@registry.add(f"WITH {_ENDS} SELECT ticker, horizon, {six('forecast', 'forecast')} FROM ({_FORECASTS['ar1']})")
def forecast_ar1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(regime.forecast_ar1(closes(spark, sf_dir), [1, 5]), "forecast")


@registry.add(f"WITH {_ENDS} SELECT ticker, horizon, {six('forecast', 'forecast')} FROM ({_FORECASTS['ols']})")
def forecast_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ols(closes(spark, sf_dir), [1, 5]), "forecast")


_ALL = " UNION ALL ".join(f"SELECT '{m}' AS model, * FROM ({sql})" for m, sql in _FORECASTS.items())
_ERRORS = f"""{SMALL}, back AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM small),
ew AS (WITH {_ends(f'(SELECT * FROM back WHERE k > {HELD_BACK})')}, f AS ({_ALL}), e AS (SELECT model, power(forecast - close, 2) AS mse FROM f JOIN back ON back.ticker = f.ticker AND k = {HELD_BACK + 1} - horizon),
  iw AS (SELECT model, 1 / greatest(avg(mse), 1e-10) AS w FROM e GROUP BY 1) SELECT model, w / sum(w) OVER () AS weight FROM iw),
{_ends('small')}, f AS ({_ALL})"""


def forecasts(spark: SparkSession, sf_dir: str, series: DataFrame | None = None) -> DataFrame:
    series, whole = series or cut(closes(spark, sf_dir)), None
    for name, f in {"drift": regime.forecast_drift, "ar1": regime.forecast_ar1, "ols": ols}.items():
        part = f(series, [1, HELD_BACK]).withColumn("model", F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def model_weights(spark: SparkSession, sf_dir: str, series: DataFrame) -> DataFrame:
    """Weights by the errors of forecasts from all but a ticker's last HELD_BACK values, against those."""
    from pyspark.sql import Window

    back = cut(series.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))))
    actual = back.where(F.col("k") <= HELD_BACK).select("ticker", (HELD_BACK + 1 - F.col("k")).alias("horizon"), F.col("value").alias("actual"))
    made = forecasts(spark, sf_dir, back.where(F.col("k") > HELD_BACK).drop("k")).join(actual, ["ticker", "horizon"])
    return regime.ensemble_weights(made.select("model", F.pow(F.col("forecast") - F.col("actual"), F.lit(2.0)).alias("mse")))


@registry.add(f"WITH {_ERRORS} SELECT model, {six('weight', 'weight')} FROM ew")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(model_weights(spark, sf_dir, cut(closes(spark, sf_dir))), "weight")


@registry.add(f"WITH {_ERRORS} SELECT ticker, horizon, {six('sum(forecast * weight)', 'forecast')} FROM f JOIN ew USING (model) GROUP BY 1, 2")
def ensemble_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = cut(closes(spark, sf_dir))
    return shown(regime.ensemble_combine(forecasts(spark, sf_dir, series), cut(model_weights(spark, sf_dir, series))), "forecast")


# graphs

_CORR = f"{SMALL}, r AS (SELECT date, ticker, returns AS x FROM small WHERE returns IS NOT NULL), cc AS (SELECT a.ticker AS src, b.ticker AS dst, coalesce(corr(a.x, b.x), 0) AS c FROM r a JOIN r b ON b.date = a.date AND a.ticker < b.ticker GROUP BY 1, 2)"
_EDGES = "edges AS (SELECT src, dst, c AS weight FROM cc WHERE abs(c) >= 0.15 UNION ALL SELECT dst, src, c FROM cc WHERE abs(c) >= 0.15 UNION ALL SELECT DISTINCT ticker, ticker, 1.0 FROM r)"


@registry.add(f"WITH {_CORR}, {_EDGES} SELECT src, dst, {six('weight', 'weight')} FROM edges")
def corr_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(graph.corr_graph(staged(spark, sf_dir), 0.15), "weight")


_NODES = """n1 AS (SELECT ticker, date, x, lag(x) OVER (PARTITION BY ticker ORDER BY date) AS before, sum(x) OVER (PARTITION BY ticker ORDER BY date) AS total FROM r), n2 AS (SELECT *, max(total) OVER (PARTITION BY ticker ORDER BY date) - total AS fall FROM n1),
nodes AS (SELECT ticker, avg(x) AS mean, stddev_pop(x) AS std, avg(x) / (stddev_pop(x) + 1e-8) AS ratio, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, coalesce(corr(x, before), 0) AS autocorr, avg((x > 0)::INT) AS win_rate, max(fall) AS max_drawdown FROM n2 GROUP BY 1)"""
_NUMBERS = ("mean", "std", "ratio", "p5", "p95", "autocorr", "win_rate", "max_drawdown")


@registry.add(f"WITH {_CORR}, {_NODES} SELECT ticker, {', '.join(six(c, c) for c in _NUMBERS)} FROM nodes")
def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(graph.node_features(small(spark, sf_dir)), *_NUMBERS)


@registry.add(f"WITH {_CORR}, {_EDGES}, {_NODES} SELECT dst AS ticker, {six('sum(weight * std)', 'std')}, {six('sum(weight * win_rate)', 'win_rate')} FROM edges JOIN nodes ON ticker = src GROUP BY 1")
def neighbour_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = staged(spark, sf_dir)
    return shown(graph.corr_aggregate(panel, graph.node_features(panel), ["std", "win_rate"], 0.15), "std", "win_rate")


