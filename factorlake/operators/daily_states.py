"""Scores and correlations as of a date from daily states: a new date costs its own cross-section, a window is a sum of states.

A state of a date is what its cross-section adds: the information coefficients of features, and for every pair of features the count, the means and the
central sums of squares and products over the rows that have both. States are stored by date; adding a date writes that date's
folder alone (again, if it is repeated), and any window is merged from the states between two dates without reading the matrix.

A cross-section, the rows of one date, is held by one task; states are as large as the square of the features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.operators import research

PAIRS = "date timestamp, i int, n array<long>, ma array<double>, mb array<double>, va array<double>, vb array<double>, c array<double>"
SCORES = "date timestamp, feature string, ic double"


def pair_states(matrix: DataFrame, features: list[str]) -> DataFrame:
    """``PAIRS``: a row for each date and feature with the arrays over all other features; a null is no value."""

    def of_date(rows: pa.Table) -> pa.Table:
        x = np.column_stack([rows.column(f).to_numpy().astype(float) for f in features])
        held = ~np.isnan(x)
        mask = held.astype(float)
        centre = np.where(held.any(axis=0), np.where(held, x, 0.0).sum(axis=0) / np.maximum(mask.sum(axis=0), 1), 0.0)
        x = np.where(held, x - centre, 0.0)
        n, sums = mask.T @ mask, x.T @ mask
        some = np.maximum(n, 1)
        means, squares = sums / some, (x * x).T @ mask - sums * sums / some
        products = x.T @ x - sums * sums.T / some
        made = {"n": n.astype(np.int64), "ma": means + centre[:, None], "mb": (means + centre[:, None]).T, "va": squares, "vb": squares.T, "c": products}
        date = pa.array([rows.column("date")[0].as_py()] * len(features), rows.schema.field("date").type)
        return pa.table({"date": date, "i": pa.array(range(len(features)), pa.int32()), **{k: pa.array([*v]) for k, v in made.items()}})

    rows = matrix.select(F.col("date").cast("timestamp").alias("date"), *[F.col(f).cast("double").alias(f) for f in features])
    return rows.groupBy("date").applyInArrow(of_date, PAIRS)


def ic_states(long: DataFrame, forward: DataFrame, min_obs: int = 3) -> DataFrame:
    """``SCORES``: a date's information coefficients of features (date, ticker, feature, value) against (date, ticker, fwd)."""
    return research.ic_series(long, forward, min_obs).select(F.col("date").cast("timestamp").alias("date"), "feature", "ic")


def correlations(states: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) for a before b: Pearson over all rows of the states' dates that have both; null if one doesn't vary.

    Central sums are merged about the common mean, so nothing large is subtracted.
    """
    names = F.array(*map(F.lit, features))
    cells = states.select("i", F.posexplode(F.arrays_zip("n", "ma", "mb", "va", "vb", "c")).alias("j", "x")).select("i", "j", "x.*").where("i < j and n > 0")
    whole = cells.groupBy("i", "j").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("ma")) / F.sum("n")).alias("a_mean"), (F.sum(F.col("n") * F.col("mb")) / F.sum("n")).alias("b_mean"))
    gap_a, gap_b, n = F.col("ma") - F.col("a_mean"), F.col("mb") - F.col("b_mean"), F.col("n")
    sums = cells.join(whole, ["i", "j"]).groupBy("i", "j").agg(F.max("all").alias("all"), F.sum(F.col("va") + n * gap_a * gap_a).alias("va"), F.sum(F.col("vb") + n * gap_b * gap_b).alias("vb"), F.sum(F.col("c") + n * gap_a * gap_b).alias("c"))
    r = F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / F.sqrt(F.col("va") * F.col("vb")))
    return sums.where("all > 1").select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"))


class DailyStates:
    """States of one kind (``PAIRS`` or ``SCORES``) in folders by date."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, states: DataFrame) -> None:
        """Write the dates of ``states``; those already there are replaced, all others are not touched."""
        days = states.withColumn("day", F.date_format("date", "yyyy-MM-dd"))
        days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def between(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The states of the dates from ``first`` to ``last`` (yyyy-MM-dd, both included); only their folders are read."""
        held = self.spark.read.schema(f"{self.schema}, day string").parquet(self.path)
        held = held.where(F.col("day") >= first) if first else held
        return (held.where(F.col("day") <= last) if last else held).drop("day")
