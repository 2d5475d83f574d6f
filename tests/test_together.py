"""Columns of several families in one plan, and six digits without texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.functions import kernels as K
from factorlake.functions.scalar import six_digits, with_six_digits
from factorlake.operators import panel as P
from factorlake.plans import features as families
from factorlake.plans import matrix
from factorlake.queries import feature_rows
from factorlake.sources import derived

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_families_are_made_without_joining_them(spark):
    price, value = (plan_of(query(spark, SF)) for query in (feature_rows.feature_rows_price, feature_rows.feature_rows_value))
    assert "FullOuter" not in price + value
    assert "format_string" not in price + value
    assert 0 < price.count("MapInArrow") < 10  # a pass for a depth, not for a family
    assert "windowspecdefinition(date" not in price and "windowspecdefinition(date" in value  # only ranks are dealt by date


def test_together_equals_the_joined_families(spark):
    grid = matrix.staged(derived.bars(spark, SF))
    wanted = ["mom_20d", "mom_zscore_20d", "beta_60d", "rsi_14", "vol_rank_20d", "rsi_price_divergence"]
    made = [families.momentum(), families.volatility(), families.volume(), families.technical()]
    together = matrix.together(grid, made, wanted).toPandas().set_index(["date", "ticker"]).sort_index()
    parts = [matrix.rows_of(f, matrix.plans(derived.bars(spark, SF), None, grid)[f]) for f in ("momentum", "volatility", "volume", "technical")]
    joined = P.join_features_outer([(df, [n for n in names if n in wanted]) for df, names in parts]).toPandas().set_index(["date", "ticker"]).sort_index()
    assert len(together) == len(joined) > 0
    assert np.allclose(together[wanted].to_numpy(float), joined[wanted].to_numpy(float), rtol=1e-9, atol=1e-12, equal_nan=True)


def test_a_name_defined_in_two_ways_is_refused():
    assert K.merged([[{"a": "x"}, {"b": "a + 1"}], [{"b": "a + 1"}, {"c": "b"}]]) == [{"a": "x", "b": "a + 1"}, {"c": "b"}]
    with pytest.raises(ValueError):
        K.merged([[{"a": "x"}], [{"a": "y"}]])


def test_six_digits_without_texts(spark):
    rng = np.random.default_rng(5)
    odd = [0.0, -0.0, 1e-12, 9.99e-13, -1e-13, 0.5, 1.000005, 999999.5, 99999.95, 123456.5, 1234565.0, -1234575.0, 9.999995, 1e22, 1e23, 3.3e300, -2e-11, float("inf"), float("-inf"), float("nan"), None]
    rows = [(v,) for v in [*odd, *(rng.standard_normal(3000) * 10.0 ** rng.integers(-14, 30, 3000)).tolist(), *(rng.integers(0, 10**7, 3000) / 20).tolist(), *(10.0 ** rng.integers(-11, 25, 100)).tolist()]]
    df = spark.createDataFrame(rows, "x double").select(F.monotonically_increasing_id().alias("i"), "x", F.col("x").alias("y"))
    both = with_six_digits(df.withColumn("want", six_digits(F.col("x"))), ["x"])
    assert both.where("NOT x <=> want").collect() == []
    assert both.where("x IS NULL").count() == 1


def test_a_dense_block_is_computed_as_one_with_holes_at_its_end():
    import pyarrow as pa
    from factorlake.functions import series

    rng = np.random.default_rng(9)
    ops = {"avg": ("avg", ("a",), (3, 1)), "cov": ("covar_samp", ("a", "b"), (4, 2)), "lag": ("lag", ("a",), (2,)), "at": ("position", (), ()), "ewm": ("ewm", ("b",), (5,)), "rank": ("own_rank", ("a",), ())}
    lengths = [6, 6, 6]
    a = pa.array(rng.standard_normal(18), mask=rng.random(18) < 0.3)
    b = pa.array(rng.standard_normal(18), mask=rng.random(18) < 0.3)
    dense = pa.table({series.POSITION: np.concatenate([np.arange(1, n + 1) for n in lengths]), "a": a, "b": b})
    ragged = pa.concat_tables([dense, pa.table({series.POSITION: [1], "a": [1.0], "b": [2.0]})])
    one, other = series.computed(dense, ops), series.computed(ragged, ops)
    assert all(one[name].to_pylist() == other[name].to_pylist()[:18] for name in ops)


def test_columns_that_nothing_needs_are_not_made(spark):
    plan = plan_of(feature_rows.feature_rows_value(spark, SF))
    assert "l_orderkey" in plan and "count(distinct" not in plan.lower() and "asset_growth" not in plan
