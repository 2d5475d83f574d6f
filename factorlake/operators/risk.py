"""Costs, position ledgers, performance, risk and attribution over many strategies and portfolios at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.staging import cut


def transaction_cost(q: Column, adv: Column, volatility: Column, price: Column, commission: float = 0.0005, spread: float = 0.0010) -> Column:
    """|q| times half spread, commission and square-root impact; 0 without a trade or volume."""
    size = F.abs(q)
    cost = size * ((spread / 2 + commission) * price + volatility * F.sqrt(size / adv) * price)
    return F.when((q == 0) | (adv <= 0), F.lit(0.0)).otherwise(cost)


def rolling_adv(panel: DataFrame, n: int = 30) -> DataFrame:
    return panel.withColumn("adv", F.expr(f"avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"))


def rolling_vol30(panel: DataFrame) -> DataFrame:
    """Deviation of one-date changes of close over 30 dates as a hundredth, 0 where unknown."""
    changed = panel.withColumn("_ch", F.expr("close - lag(close) OVER (PARTITION BY ticker ORDER BY date)"))
    sd = F.expr("stddev_samp(_ch) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
    return changed.withColumn("volatility", F.coalesce(sd, F.lit(0.0)) / 100).drop("_ch")


LEDGER = "strategy string, ticker string, date timestamp, shares double, trade double, cost double, cash double, value double"


def position_ledger(rows: DataFrame, capital: float = 1e6, commission: float = 0.0005, spread: float = 0.0010) -> DataFrame:
    """The ledger of each (strategy, ticker): each date trades to value * clip(previous signal, -1, 1) / price and pays costs.

    rows: (strategy, ticker, date, signal, close, adv, volatility). The fold is sequential in dates; strategies, tickers and cost
    settings run side by side, one group of (date) rows each.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("date")
        signal, price, adv, vol = (group[c].fillna(0).to_numpy(float) for c in ("signal", "close", "adv", "volatility"))
        n, cash, held, value = len(group), capital, 0.0, capital
        out = np.zeros((n, 5))
        out[0] = 0, 0, 0, cash, value
        for t in range(1, n):
            worth = cash + held * price[t]
            target = worth * min(max(signal[t - 1], -1.0), 1.0) / price[t] if price[t] > 0 else held
            q = target - held
            cost = 0.0 if q == 0 or adv[t] <= 0 else abs(q) * ((spread / 2 + commission) * price[t] + vol[t] * np.sqrt(abs(q) / adv[t]) * price[t])
            cash -= q * price[t] + cost
            held, value = target, cash + target * price[t]
            out[t] = held, q, cost, cash, value
        made = pd.DataFrame(out, columns=["shares", "trade", "cost", "cash", "value"])
        return pd.concat([group[["strategy", "ticker", "date"]].reset_index(drop=True), made], axis=1)

    return rows.select("strategy", "ticker", F.col("date").cast("timestamp").alias("date"), "signal", "close", "adv", "volatility").groupBy("strategy", "ticker").applyInPandas(fold, LEDGER)


def perf_metrics(values: DataFrame, key: list[str], benchmark: str | None = None) -> DataFrame:
    """By key: n, total return, Sharpe (sample deviation), largest drawdown, Calmar, information ratio (population deviation). Fewer than two values: 0."""
    w = Window.partitionBy(*key).orderBy("date")
    rows = values.withColumn("r", F.col("value") / F.nullif(F.lag("value").over(w), F.lit(0.0)) - 1).withColumn("peak", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("dd", F.col("value") / F.nullif("peak", F.lit(0.0)) - 1).withColumn("active", F.col("r") - (F.col(benchmark) if benchmark else F.lit(0.0)))
    sums = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.min("dd").alias("dd"), F.avg("active").alias("am"), F.stddev_pop("active").alias("asd")
    )
    zero = lambda c: F.coalesce(F.when(F.col("n") >= 2, c), F.lit(0.0))
    annual = F.lit(252.0)
    return sums.select(
        *key, "n", zero(F.col("last") / F.nullif("first", F.lit(0.0)) - 1).alias("total_return"), zero(F.when(F.col("s") > 1e-12, F.col("m") / F.col("s") * F.sqrt(annual))).alias("sharpe"), zero(F.col("dd")).alias("max_drawdown"),
        zero(F.when(F.col("dd") < -1e-12, F.col("m") * annual / -F.col("dd"))).alias("calmar"), zero(F.when(F.col("asd") > 1e-12, F.col("am") / F.col("asd") * F.sqrt(annual))).alias("information_ratio"),
    )


def survivorship_adjust(panel: DataFrame, delistings: DataFrame, terminal: float = -0.3) -> DataFrame:
    """Closes with the terminal return on a ticker's delisting date, and no rows after it."""
    joined = panel.join(delistings, "ticker", "left").where(F.col("delist_date").isNull() | (F.to_date("date") <= F.col("delist_date")))
    return joined.withColumn("close", F.when(F.to_date("date") == F.col("delist_date"), F.col("close") * (1 + terminal)).otherwise(F.col("close"))).drop("delist_date")


def scenario_pnl(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio, date, pnl): returns (date, ticker, r) times weights (portfolio, ticker, weight), summed."""
    return returns.join(weights, "ticker").groupBy("portfolio", "date").agg(F.sum(F.col("r") * F.col("weight")).alias("pnl"))


def empirical_var_cvar(pnl: DataFrame, alpha: float = 0.95) -> DataFrame:
    """(portfolio, var, cvar): the interpolated (1 - alpha) quantile, and minus the mean of what lies at or below it."""
    q = pnl.groupBy("portfolio").agg(F.expr(f"percentile(pnl, {round(1 - alpha, 10)}D)").alias("var"))
    return pnl.join(q, "portfolio").groupBy("portfolio").agg(F.max("var").alias("var"), (-F.avg(F.when(F.col("pnl") <= F.col("var"), F.col("pnl")))).alias("cvar"))


def ru_cvar(pnl: DataFrame, alpha: float = 0.95) -> DataFrame:
    """(portfolio, cvar): the least of g + sum(max(loss - g, 0)) / ((1 - alpha) n) over all losses g.

    The minimum is at an order statistic, so suffix sums of the sorted losses give the objective at every candidate: no product of losses with losses.
    """
    losses = pnl.select("portfolio", (-F.col("pnl")).alias("g"))
    above = Window.partitionBy("portfolio").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy("portfolio"))
    value = F.col("g") + (F.sum("g").over(above) - F.count("*").over(above) * F.col("g")) / ((1 - alpha) * n)
    return losses.select("portfolio", value.alias("v")).groupBy("portfolio").agg(F.min("v").alias("cvar"))


def constraint_check(weights: DataFrame, expected: DataFrame, cvar: DataFrame, previous: DataFrame | None = None, most_cvar: float = 0.025, least_return: float = 0.0, most_weight: float = 0.2, most_turnover: float = 0.2) -> DataFrame:
    """A row for each portfolio with the value and truth of each constraint, and whether all hold."""
    joined = weights.join(expected, "ticker", "left")
    joined = joined.join(previous, ["portfolio", "ticker"], "left") if previous is not None else joined.withColumn("previous", F.col("weight"))
    sums = joined.groupBy("portfolio").agg(
        F.sum("weight").alias("total"), F.sum(F.col("weight") * F.coalesce("mu", F.lit(0.0))).alias("mu"), F.min("weight").alias("low"), F.max("weight").alias("high"), F.sum(F.abs(F.col("weight") - F.coalesce("previous", F.lit(0.0)))).alias("turnover")
    ).join(cvar, "portfolio")
    checks = {"cvar_ok": F.col("cvar") <= most_cvar, "return_ok": F.col("mu") >= least_return, "total_ok": F.col("total").between(0.9, 1.1), "bounds_ok": (F.col("low") >= 0) & (F.col("high") <= most_weight + 1e-12), "turnover_ok": F.col("turnover") <= most_turnover}
    sums = sums.select("portfolio", "total", "mu", "cvar", "turnover", *[c.alias(n) for n, c in checks.items()])
    return sums.withColumn("feasible", F.expr(" AND ".join(checks)))


def candidate_portfolio_search(checked: DataFrame) -> DataFrame:
    """One row: the feasible portfolio of least CVaR (the smallest name of equals); no row if none is, when equal weights apply."""
    best = checked.where("feasible").agg(F.min_by(F.struct("portfolio", "cvar", "mu"), F.struct("cvar", "portfolio")).alias("x"))
    return best.where("x is not null").select("x.portfolio", "x.cvar", "x.mu")


def candidate_weights(tickers: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """(portfolio, ticker, weight): n random weight vectors (normalised exponentials) over tickers(ticker), made where they are used."""
    rows = tickers.select("ticker").withColumn("portfolio", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    drawn = rows.withColumn("e", -F.log((F.pmod(F.xxhash64("portfolio", "ticker", F.lit(seed)), F.lit(1_000_003)) + 1) / 1_000_004.0))
    return drawn.select("portfolio", "ticker", (F.col("e") / F.sum("e").over(Window.partitionBy("portfolio"))).alias("weight"))


def weight_clip_normalise(weights: DataFrame, most: float = 0.2) -> DataFrame:
    clipped = weights.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.col("weight"), F.lit(most))))
    return clipped.withColumn("weight", F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy("portfolio")), F.lit(0.0)))


def bl_posterior(views: DataFrame, tau: float = 0.05) -> DataFrame:
    """Black-Litterman posterior means of many universes: (universe, ticker, mu).

    views: one row for each universe with tickers array<string>, pi array<double>, sigma and p array<array<double>>, q and omega
    array<double> (omega: variances of views). A universe's matrices are given whole, so this is for short lists of tickers; ``bl_update`` works from
    returns and has no such matrix. A singular system gives pi.
    """

    def solve(batches):
        for rows in batches:
            out = {"universe": [], "ticker": [], "mu": []}
            for r in rows.itertuples(index=False):
                pi, sigma, p = np.array(r.pi), np.array([np.array(x) for x in r.sigma]), np.array([np.array(x) for x in r.p])
                try:
                    prior, noise = np.linalg.inv(tau * sigma), np.linalg.inv(np.diag(np.array(r.omega)))
                    mu = np.linalg.solve(prior + p.T @ noise @ p, prior @ pi + p.T @ noise @ np.array(r.q))
                except np.linalg.LinAlgError:
                    mu = pi
                out["universe"] += [r.universe] * len(pi)
                out["ticker"] += list(r.tickers)
                out["mu"] += mu.tolist()
            yield pd.DataFrame(out)

    return views.mapInPandas(solve, "universe string, ticker string, mu double")


def bl_update(returns: DataFrame, views: DataFrame, quotes: DataFrame, tau: float = 0.05) -> DataFrame:
    """Black-Litterman posterior means of many universes with few views: (universe, ticker, mu).

    returns (universe, ticker, date, r), the prior of a ticker being its mean; views (universe, view, ticker, p); quotes (universe, view, q,
    omega). A view is a portfolio, so its covariance with each ticker is that of two return series, over the dates on which all of the
    view's tickers have one: joins and grouped sums give it, and only systems as large as the views are solved in Python. A view without
    two such dates is left out, and a singular system leaves the prior.
    """
    prior = returns.groupBy("universe", "ticker").agg(F.avg("r").alias("pi"))
    legs = views.groupBy("universe", "view").agg(F.count("*").alias("legs"))
    moved = returns.join(views, ["universe", "ticker"]).groupBy("universe", "view", "date").agg(F.sum(F.col("r") * F.col("p")).alias("v"), F.count("*").alias("n"))
    series = cut(moved.join(legs, ["universe", "view"]).where("n = legs").select("universe", "view", "date", "v"))
    cross = returns.join(series, ["universe", "date"]).groupBy("universe", "view", "ticker").agg(F.covar_samp("r", "v").alias("c"))
    both = series.join(series.select("universe", "date", F.col("view").alias("other"), F.col("v").alias("w")), ["universe", "date"])
    inner = both.groupBy("universe", "view", "other").agg(F.covar_samp("v", "w").alias("c")).where("c is not null").groupBy("universe").agg(F.collect_list(F.struct("view", "other", "c")).alias("cov"))
    expected = views.join(prior, ["universe", "ticker"]).groupBy("universe", "view").agg(F.sum(F.col("p") * F.col("pi")).alias("m"))
    asked = quotes.join(expected, ["universe", "view"]).groupBy("universe").agg(F.collect_list(F.struct("view", "omega", (F.col("q") - F.col("m")).alias("gap"))).alias("asked"))

    def solve(batches):
        for rows in batches:
            out = {"universe": [], "view": [], "w": []}
            for r in rows.itertuples(index=False):
                known = {(c["view"], c["other"]): c["c"] for c in r.cov}
                names = sorted(a["view"] for a in r.asked if (a["view"], a["view"]) in known)
                by_name = {a["view"]: a for a in r.asked}
                system = np.array([[tau * known.get((a, b), 0.0) + (by_name[a]["omega"] if a == b else 0.0) for b in names] for a in names])
                try:
                    weights = np.linalg.solve(system, np.array([by_name[a]["gap"] for a in names])) if names else np.zeros(0)
                except np.linalg.LinAlgError:
                    weights = np.zeros(len(names))
                out["universe"] += [r.universe] * len(names)
                out["view"] += names
                out["w"] += weights.tolist()
            yield pd.DataFrame(out)

    solved = asked.join(inner, "universe").mapInPandas(solve, "universe string, view string, w double")
    shift = cross.join(solved, ["universe", "view"]).groupBy("universe", "ticker").agg(F.sum(tau * F.coalesce("c", F.lit(0.0)) * F.col("w")).alias("d"))
    return prior.join(shift, ["universe", "ticker"], "left").select("universe", "ticker", (F.col("pi") + F.coalesce("d", F.lit(0.0))).alias("mu"))


def brinson_attribution(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(segment, allocation, selection, interaction, total), and a row ``TOTAL``; sides are (segment, weight, r), missing segments 0."""
    p, b = portfolio.select("segment", F.col("weight").alias("wp"), F.col("r").alias("rp")), benchmark.select("segment", F.col("weight").alias("wb"), F.col("r").alias("rb"))
    both = p.join(b, "segment", "full").fillna(0.0, ["wp", "rp", "wb", "rb"])
    both = both.crossJoin(b.agg(F.coalesce(F.sum(F.col("wb") * F.col("rb")), F.lit(0.0)).alias("rt")))  # one row
    parts = both.select("segment", ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("rt"))).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"), ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"))
    names = ["allocation", "selection", "interaction"]
    rolled = parts.rollup("segment").agg(*[F.sum(n).alias(n) for n in names])
    return rolled.select(F.coalesce("segment", F.lit("TOTAL")).alias("segment"), *names, (F.col("allocation") + F.col("selection") + F.col("interaction")).alias("total"))


def save_portfolio(portfolio: DataFrame, path: str) -> None:
    """Appends (portfolio_id, symbol, weight, timestamp) rows of a table with one map of weights a portfolio."""
    portfolio.select("portfolio_id", F.explode("weights").alias("symbol", "weight"), "timestamp").write.mode("append").parquet(path)
