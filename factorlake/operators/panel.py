"""Panel alignment: dense grids, as-of joins, exponential means, outer joins of feature groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.functions import series
from factorlake.functions.kernels import apply_layers, change, fill_forward
from factorlake.plans.features import EMA_SPANS, MACD

KEY = ["date", "ticker"]


def panel_densify(panel: DataFrame) -> DataFrame:
    """Every date of the universe for every ticker, nulls where there was no row.

    The grid is the product of two short lists (dates, tickers): its size is what the result needs anyway.
    """
    grid = panel.select("date").distinct().crossJoin(panel.select("ticker").distinct())
    return grid.join(panel, KEY, "left")


def returns(panel: DataFrame) -> DataFrame:
    """One-date returns of adj_close on a dense panel."""
    return apply_layers(panel, [{"returns": change("adj_close")}])


def select_optional(panel: DataFrame, column: str, fallback: str) -> Column:
    return F.col(column if column in panel.columns else fallback).alias(column)


def ranged(panel: DataFrame) -> DataFrame:
    """The panel with high and low, the close where they are absent."""
    return panel.select("*", *[select_optional(panel, c, "adj_close") for c in ("high", "low") if c not in panel.columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null everywhere (one pass over all columns)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if counts[c]])


def dedup_columns(groups: list[tuple[DataFrame, list[str]]]) -> list[tuple[DataFrame, list[str]]]:
    """Feature groups without names that an earlier group has."""
    seen: set[str] = set()
    kept = []
    for df, names in groups:
        own = [n for n in dict.fromkeys(names) if n not in seen]
        seen.update(own)
        kept.append((df, own))
    return kept


def join_features_outer(groups: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Full outer join of feature groups on (date, ticker); of equal names the first wins."""
    joined = None
    for df, names in dedup_columns(groups):
        part = df.select(*KEY, *names)
        joined = part if joined is None else joined.join(part, KEY, "full")
    return joined


def union_dates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("date").union(b.select("date")).distinct()


def asof_fundamentals(panel: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """panel with each fundamentals column as last known at its date; a column at a time, nulls are skipped.

    Both sides are stacked and filled forward in one window by ticker: no range join.
    """
    numbers = [c for c in fundamentals.columns if c not in KEY]
    left = panel.withColumn("_row", F.lit(True))
    stacked = left.unionByName(fundamentals.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    # at equal dates a report is known to the bar of that date
    order = "PARTITION BY ticker ORDER BY date, _row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    filled = stacked.select(*[c for c in panel.columns if c not in numbers], "_row", *[F.expr(f"last_value({c}) IGNORE NULLS OVER ({order})").alias(c) for c in numbers])
    return filled.where("_row").drop("_row")


def join_left_panel(panel: DataFrame, fundamentals: DataFrame) -> DataFrame:
    return panel.join(fundamentals, KEY, "left")


def join_optional_named(panel: DataFrame, names: list[str], *sources: DataFrame) -> DataFrame:
    """panel with each named feature from the first source that has it, else 0; then filled forward, then 0."""
    out = panel
    for source in sources:
        own = [n for n in names if n in source.columns and n not in out.columns]
        if own:
            out = out.join(source.select(*KEY, *own), KEY, "left")
    out = out.select("*", *[F.lit(0.0).alias(n) for n in names if n not in out.columns])
    return out.select(*[c for c in out.columns if c not in names], *[F.coalesce(F.expr(fill_forward(n)), F.lit(0.0)).alias(n) for n in names])


def join_inner_pairs(feature: DataFrame, forward: DataFrame) -> DataFrame:
    return feature.join(forward, KEY).dropna()


def slice_ticker(df: DataFrame, ticker: str, columns: list[str]) -> DataFrame:
    return df.where(F.col("ticker") == ticker).select("date", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def with_home_sector(panel: DataFrame) -> DataFrame:
    """panel with ``home``: the ticker's most frequent sector, the smallest name of equals."""
    return panel.join(mode_per_key(panel, "ticker", "sector").withColumnRenamed("sector", "home"), "ticker", "left")


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def with_emas(panel: DataFrame, spans: tuple[int, ...] = EMA_SPANS, lines: dict[str, tuple[int, int, int]] = MACD, placed: bool = False) -> DataFrame:
    """panel with ema<span> columns of adj_close, and <name>_line and <name>_signal for each pair of spans.

    The recursion y = ((1 - a)^gap y + a x) / ((1 - a)^gap + a) is sequential in a ticker's dates, so it runs date by date for a block of
    tickers and all spans at once. placed: rows keep their column of places, so series windows go on in the same stage.
    """
    every = sorted({*spans, *[s for fast, slow, _ in lines.values() for s in (fast, slow)]})
    means = series.add(panel, {f"ema{s}": ("ewm", ("adj_close",), (s,)) for s in every})
    made = means.select("*", *[F.expr(f"ema{fast} - ema{slow}").alias(f"{name}_line") for name, (fast, slow, _) in lines.items()])
    made = series.add(made, {f"{name}_signal": ("ewm", (f"{name}_line",), (signal,)) for name, (_, _, signal) in lines.items()}, ordered=True) if lines else made
    named = [f"ema{s}" for s in spans] + [f"{n}_{x}" for n in lines for x in ("line", "signal")]
    return made.select(*panel.columns, *named, *([series.POSITION] if placed else []))


def ema_by_sql(panel: DataFrame, span: int) -> DataFrame:
    """The same exponential mean without Python, for short histories: an ordered fold over the ticker's values."""
    a = 2.0 / (span + 1)
    rows = panel.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "adj_close"))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("gap"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        x, weight = row["adj_close"], F.pow(F.lit(1 - a), acc["gap"] + 1)
        y = F.when(x.isNull(), acc["y"]).when(acc["y"].isNull(), x).otherwise((weight * acc["y"] + a * x) / (weight + a))
        return F.struct(y.alias("y"), F.when(x.isNull(), acc["gap"] + 1).otherwise(F.lit(0)).alias("gap"), F.concat(acc["out"], F.array(y)).alias("out"))

    folded = rows.select("ticker", F.explode(F.arrays_zip(F.col("s.date").alias("date"), F.aggregate("s", start, step, lambda acc: acc["out"]).alias("ema"))).alias("x"))
    return folded.select("x.date", "ticker", "x.ema")


def subset_check(features: DataFrame, panel: DataFrame) -> bool:
    """Whether every ticker of the features is one of the panel's."""
    return features.select("ticker").distinct().join(panel.select("ticker").distinct(), "ticker", "left_anti").isEmpty()
