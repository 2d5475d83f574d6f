"""Keyed tables as Parquet: latest-wins upserts, inserts if absent, updates, deletes, as-of reads, pages of logs.

A table is a DataFrame; a change is a new DataFrame that the caller writes, by partition if the table is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_by_key(table: DataFrame, changes: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Rows of both, the change where a key is in both; of several changes of a key the one of the largest ``version``."""
    if version:
        at = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
        changes = changes.withColumn("_at", at).where("_at = 1").drop("_at")
    else:
        changes = changes.dropDuplicates(key)
    kept = table.join(changes.select(*key), key, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)


def insert_if_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.dropDuplicates(key).join(table.select(*key), key, "left_anti"))


def update_by_key(table: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Non-null values replace the table's; other columns and rows stay."""
    changed = [c for c in values.columns if c not in key]
    joined = table.join(values.select(*key, *[F.col(c).alias(f"_{c}") for c in changed]), key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in table.columns])


def delete_by_key(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key), key, "left_anti")


def get_by_key(table: DataFrame, **key) -> DataFrame:
    condition: Column = F.lit(True)
    for name, value in key.items():
        condition = condition & (F.col(name) == F.lit(value))
    return table.where(condition)


def fk_lookup(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_semi")


def bars_as_of_k(bars: DataFrame, cutoffs: DataFrame, k: int) -> DataFrame:
    """The last k bars at or before each symbol's cut-off, oldest first; cutoffs: (symbol, cutoff), one for a symbol."""
    known = bars.join(cutoffs, "symbol").where(F.col("timestamp") <= F.col("cutoff"))
    at = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("timestamp")))
    return known.withColumn("_at", at).where(F.col("_at") <= k).drop("_at", "cutoff").orderBy("symbol", "timestamp")


def latest_bar_as_of(bars: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """One bar for each symbol: the latest at or before its cut-off; no window, only a partial maximum by key."""
    known = bars.join(cutoffs, "symbol").where(F.col("timestamp") <= F.col("cutoff"))
    rest = [c for c in bars.columns if c != "symbol"]
    return known.groupBy("symbol").agg(F.max_by(F.struct(*rest), "timestamp").alias("bar")).select("symbol", "bar.*")


def filter_as_of(bars: DataFrame, symbol: str, cutoff) -> DataFrame:
    return bars.where((F.col("symbol") == symbol) & (F.col("timestamp") <= F.lit(cutoff)))


def filter_finite_pairs(df: DataFrame, a: str, b: str, key: list[str], least: int = 5) -> DataFrame:
    """Rows in which both are finite, of keys with more than ``least`` such rows."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = df.where(finite(a) & finite(b))
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where(F.col("_n") > least).drop("_n")


def latest_causal_result(results: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("hypothesis_id").orderBy(F.desc("created_at"), F.desc("result_id")))
    return results.withColumn("_at", at).where("_at = 1").drop("_at")


def latest_version_by_thread(versions: DataFrame) -> DataFrame:
    rest = [c for c in versions.columns if c != "thread_id"]
    return versions.groupBy("thread_id").agg(F.max_by(F.struct(*rest), "version_id").alias("v")).select("thread_id", "v.*")


def list_before(versions: DataFrame, thread: str, before, n: int) -> DataFrame:
    return versions.where((F.col("thread_id") == thread) & (F.col("version_id") < F.lit(before))).orderBy(F.desc("version_id")).limit(n)


def logs_page(logs: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return logs.orderBy("timestamp", "log_id").offset(offset).limit(n)


def episodes_by_workflow(logs: DataFrame, workflow: str) -> DataFrame:
    return logs.where(F.col("workflow_id") == workflow).orderBy("timestamp", "log_id")


def episodes_by_agent(logs: DataFrame, agent: str) -> DataFrame:
    return logs.where(F.col("agent_name") == agent).orderBy(F.desc("timestamp"), F.desc("log_id"))


def facts_by_agent(facts: DataFrame, agent: str, key: str | None = None) -> DataFrame:
    rows = facts.where(F.col("agent_name") == agent)
    return rows.where(F.col("memory_key") == key) if key else rows


def pivot_metrics(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(run_id, metric, value) of a table with a column for each metric."""
    return runs.unpivot(["run_id"], metrics, "metric", "value").where("value is not null")


def period_change_summary(bars: DataFrame) -> DataFrame:
    """(ticker, first_close, last_close, change) over the rows given."""
    ends = bars.groupBy("ticker").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"))
    return ends.withColumn("change", F.col("last_close") / F.nullif("first_close", F.lit(0.0)) - 1)


def count_distinct_sources(rows: DataFrame, key: str, source: str = "source") -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(source).alias("n_sources"), F.array_sort(F.collect_set(source)).alias("sources"))


def valid_hypotheses(rows: DataFrame) -> DataFrame:
    """Rows that keep the record's contract: a known direction and a confidence from 0 to 1."""
    return rows.where(F.lower("predicted_direction").isin("positive", "negative", "neutral") & F.col("confidence").between(0.0, 1.0))
