"""Readers for market panels, fundamentals, delistings and papers, and fixtures made by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FUNDAMENTALS = ("pe_ratio", "pb_ratio", "roe", "roa", "gross_margin", "earnings_yield", "debt_equity", "current_ratio", "asset_growth", "accruals", "ev_ebitda", "dividend_yield", "log_market_cap")


def not_nan(c: str):
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def typed_panel(df: DataFrame, numbers: list[str], texts: tuple[str, ...] = ()) -> DataFrame:
    """(date, ticker, numbers as double with NaN as null, texts); columns that are absent stay absent."""
    have = set(df.columns)
    keep = [not_nan(c).alias(c) for c in numbers if c in have] + [F.col(c).cast("string").alias(c) for c in texts if c in have]
    return df.select(F.to_date("date").alias("date"), F.col("ticker").cast("string").alias("ticker"), *keep)


def with_returns(panel: DataFrame) -> DataFrame:
    """One-period returns of adj_close by ticker."""
    return panel.withColumn("returns", F.expr("adj_close / nullif(lag(adj_close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1"))


def scan_ohlcv(spark: SparkSession, path: str) -> DataFrame:
    return with_returns(typed_panel(spark.read.parquet(path), ["open", "high", "low", "close", "volume", "adj_close"]))


def scan_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    return typed_panel(spark.read.parquet(path), list(FUNDAMENTALS), ("sector",))


#: Types of the columns that a market file may have; others stay text.
MARKET_TYPES = {"date": "timestamp", "ticker": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "adj_close": "double"}


def scan_any_market_file(spark: SparkSession, path: str, ticker: str = "CUSTOM") -> DataFrame:
    """CSV (by its suffix) or Parquet; column names lower-cased and stripped; a file without tickers gets one.

    A CSV is read by a schema made of its header, so values are typed while they are parsed and no pass infers types.
    """
    if path.lower().endswith(".csv"):
        header = spark.read.option("header", True).csv(path).columns  # the first line alone
        schema = ", ".join(f"`{c}` {MARKET_TYPES.get(c.lower().strip(), 'string')}" for c in header)
        df = spark.read.schema(schema).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    else:
        df = spark.read.parquet(path)
    df = df.toDF(*[c.lower().strip() for c in df.columns])
    if "ticker" not in df.columns:
        df = df.withColumn("ticker", F.lit(ticker))
    if "adj_close" not in df.columns and "close" in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    return typed_panel(df, ["open", "high", "low", "close", "volume", "adj_close"])


def land_market_file(spark: SparkSession, path: str, out: str, ticker: str = "CUSTOM") -> DataFrame:
    """A market file written as Parquet by ticker and date, and read from there."""
    scan_any_market_file(spark, path, ticker).repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def scan_delisting(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, delist_date) from a CSV with a header."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lower().strip() for c in df.columns])
    return df.select("ticker", F.to_date("delist_date").alias("delist_date"))


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (filename, path, full_text, pages, num_pages); form feeds part pages."""
    df = spark.read.text(path, wholetext=True).select(F.col("value").alias("full_text"), F.input_file_name().alias("path"))
    pages = F.split("full_text", "\f")
    return df.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", "full_text", pages.alias("pages"), F.size(pages).alias("num_pages")).orderBy("filename")


def document_metadata(docs: DataFrame) -> DataFrame:
    """(filename, num_pages, source, path) with defaults for what is missing."""
    have = set(docs.columns)
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)
    pages = F.coalesce(F.col("num_pages"), F.lit(0)) if "num_pages" in have else F.lit(0)
    return docs.select(text("filename", "unknown").alias("filename"), pages.alias("num_pages"), text("source", "local").alias("source"), text("path", "").alias("path"))


def synthetic_panel(spark: SparkSession, n_tickers: int = 50, n_days: int = 1260, seed: int = 42) -> DataFrame:
    """Random-walk bars on business days, for fixtures."""
    days = spark.sql(f"SELECT date FROM (SELECT explode(sequence(date'2020-01-01', date_add(date'2020-01-01', {2 * n_days}))) AS date) WHERE weekday(date) < 5 ORDER BY date LIMIT {n_days}")
    tickers = spark.range(n_tickers).select(F.format_string("T%04d", "id").alias("ticker"))
    steps = days.crossJoin(tickers).repartition("ticker").sortWithinPartitions("ticker", "date").withColumns({"step": 0.0003 + 0.015 * F.randn(seed), "u": F.rand(seed + 1)})
    priced = steps.withColumn("close", 100 * F.exp(F.expr("sum(step) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")))
    return priced.select("date", "ticker", (F.col("close") * (1 - 0.002 * F.col("u"))).alias("open"), (F.col("close") * 1.01).alias("high"), (F.col("close") * 0.99).alias("low"), "close", (1e5 + 9.9e6 * F.col("u")).alias("volume"), F.col("close").alias("adj_close"))


#: Ranges of made-up fundamentals: our own, no more than plausible.
RANGES = {
    "pe_ratio": (8, 32), "pb_ratio": (0.7, 6), "roe": (-0.1, 0.3), "roa": (-0.04, 0.12), "gross_margin": (0.15, 0.65), "earnings_yield": (0.02, 0.1), "debt_equity": (0.0, 2.5),
    "current_ratio": (0.6, 3.5), "asset_growth": (-0.15, 0.25), "accruals": (-0.08, 0.08), "ev_ebitda": (4, 20), "dividend_yield": (0, 0.05), "log_market_cap": (18, 26),
}
SECTORS = ("Industry", "Banks", "Software", "Utilities", "Retail", "Transport")


def synthetic_fundamentals(spark: SparkSession, n_tickers: int = 50, n_days: int = 1260, seed: int = 42) -> DataFrame:
    """Quarterly reports for the tickers of ``synthetic_panel``, from a year before its first date to past its last; a ticker keeps its sector."""
    quarters = max(8, n_days // 63 + 4)
    rows = spark.range(n_tickers).select(F.format_string("T%04d", "id").alias("ticker"), F.explode(F.expr(f"sequence(date'2019-01-01', add_months(date'2019-01-01', {3 * (quarters + 3)}), interval 3 months)")).alias("date"))
    share = lambda *of: F.pmod(F.xxhash64(*of, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0  # noqa: E731  of the row's own values: the same however rows are dealt
    numbers = [(low + (high - low) * share("ticker", "date", F.lit(name))).alias(name) for name, (low, high) in RANGES.items()]
    sector = F.element_at(F.array(*map(F.lit, SECTORS)), (F.floor(share("ticker") * len(SECTORS)) + 1).cast("int"))
    return rows.select("date", "ticker", *numbers, sector.alias("sector"))
