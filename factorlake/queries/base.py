"""Registration of queries and the SQL tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorlake.functions.kernels import to_duckdb
from factorlake.sources import derived

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with SQL for the same rows or none."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(function: Query) -> Query:
            key = name or function.__name__
            self.queries[key] = function
            if sql:
                self.sql[key] = sql
            return function

        return keep


BARS = """
bars AS (SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS date, CAST(l_suppkey AS VARCHAR) AS ticker,
  arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS close,
  sum(l_quantity) AS volume, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS adj_close
  FROM lineitem GROUP BY 1, 2)"""

GRID = """
grid AS (SELECT d.date, t.ticker, open, high, low, close, volume, adj_close
  FROM (SELECT DISTINCT date FROM bars) d CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.date = d.date AND b.ticker = t.ticker),
dense AS (SELECT *, adj_close / nullif(lag(adj_close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS returns FROM grid)"""

_RATIOS = ", ".join(f"round({to_duckdb(sql)}, 10) AS {name}" for name, sql in derived.RATIOS.items())
FUNDAMENTALS = f"""
fsums AS (SELECT date_trunc('quarter', l_shipdate)::TIMESTAMP AS date, l_suppkey, sum(l_extendedprice) AS sum_price, sum(l_quantity) AS sum_qty,
  sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge,
  avg(l_discount) AS avg_disc, avg(l_tax) AS avg_tax, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY 1, 2),
fundamentals AS (SELECT date, CAST(l_suppkey AS VARCHAR) AS ticker, {_RATIOS}, n_name AS sector
  FROM fsums LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON s_suppkey = l_suppkey)"""

_FUND = [*derived.RATIOS, "sector"]
ASOF = f"""
stacked AS (SELECT *, TRUE AS is_row, {', '.join(f'NULL AS {c}' for c in _FUND)} FROM dense
  UNION ALL BY NAME SELECT *, FALSE AS is_row FROM fundamentals),
known AS (SELECT date, ticker, open, high, low, close, volume, adj_close, returns, {', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in _FUND)}, is_row
  FROM stacked WINDOW w AS (PARTITION BY ticker ORDER BY date, is_row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
asof_panel AS (SELECT * EXCLUDE (is_row) FROM known WHERE is_row)"""


def six(x: str, name: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-12 THEN 0 ELSE CAST(printf('%.5e', CAST({x} AS DOUBLE) * CAST(1.0000000001 AS DOUBLE) + 0.0) AS DOUBLE) END AS {name}"
