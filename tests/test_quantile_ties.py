"""A rolling quantile between two equal values is that value, not a rounded sum that a flag would take for less."""

import datetime

from factorlake.functions.kernels import apply_layers, flag, roll_quantile


def test_quantile_between_equal_values(spark):
    x = 0.45698924731182794
    rows = [("t", datetime.date(2020, 1, 1) + datetime.timedelta(days=i), x) for i in range(174)]
    made = apply_layers(spark.createDataFrame(rows, "ticker string, date date, x double"), [{"q": roll_quantile("x", 0.8, 252, 63)}, {"high": flag("x > q")}])
    assert {(r.q, r.high) for r in made.where("q is not null").collect()} == {(x, 0.0)}
