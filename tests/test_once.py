"""What is read several times is computed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import causal
from factorlake.operators import research as R


@pytest.fixture
def counted(spark):
    """(rows with ties, nulls and a NaN; a function that tells how many rows were computed so far)."""
    computed = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    r = np.random.default_rng(3)
    values = [(int(i), None if i % 11 == 0 else float(np.round(x, 1)), float(np.round(y, 1))) for i, (x, y) in enumerate(r.standard_normal((400, 2)))]
    return spark.createDataFrame(values, "id long, x double, y double").mapInArrow(run, "id long, x double, y double"), lambda: computed.value


def test_median_computes_its_rows_twice_at_most(counted):
    df, computed = counted
    made = causal.binarise_median(df, "x").toPandas()
    median = made.x.median()
    assert made.treatment.sum() == (made.x > median).sum()
    assert computed() <= 2 * 400  # for the median, and for the rows with it


def test_bounds_compute_their_rows_once_for_the_median(counted):
    df, computed = counted
    causal.rosenbaum_bounds(df.withColumn("t", F.col("id") % 2), "t", "y", [1.0, 2.0]).collect()
    assert computed() <= 2 * 400


def test_spearman_computes_its_rows_once(counted):
    df, computed = counted
    pairs = df.toPandas().dropna()
    before = computed()
    rho = R.spearman_pair(df, "x", "y", parts=7).first()[0]
    assert computed() - before <= 400
    assert rho == pytest.approx(pairs.x.rank().corr(pairs.y.rank()), abs=1e-12)


def test_spearman_of_a_constant_or_of_nothing_is_0(spark):
    assert R.spearman_pair(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()[0] == 0
    assert R.spearman_pair(spark.createDataFrame([], "x double, y double"), "x", "y").first()[0] == 0
