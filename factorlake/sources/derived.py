"""Market tables derived from the sales schema: bars, fundamentals, ticks, vectors and text chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of a supplier's unit prices; one shuffle, aggregated before it."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.date_trunc("week", "l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"),
    )
    made = lines.groupBy("date", "ticker").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("volume").alias("volume")
    )
    return made.withColumn("adj_close", F.col("close"))


#: Ratios of a supplier's sums in a quarter, named as fundamentals; rounded to ten places, so equal ratios are equal in any order of summation.
RATIOS = {
    "pe_ratio": "sum_price / nullif(sum_qty, 0)", "pb_ratio": "sum_price / nullif(sum_disc_price, 0)", "roe": "sum_disc_price / nullif(sum_charge, 0) - 0.9D",
    "roa": "avg_disc - 0.045D", "gross_margin": "sum_disc_price / nullif(sum_price, 0)", "earnings_yield": "avg_disc", "debt_equity": "avg_tax * 30",
    "current_ratio": "sum_qty / nullif(n_lines * 20.0D, 0)", "asset_growth": "n_orders / nullif(n_lines * 1.0D, 0) - 0.5D", "accruals": "avg_tax - avg_disc",
    "ev_ebitda": "sum_charge / nullif(sum_qty * 100.0D, 0)", "dividend_yield": "avg_tax", "log_market_cap": "ln(1 + sum_price)",
}


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly ratios by supplier, with the nation's name as sector (dimension tables are small and join to the aggregate)."""
    lines = table(spark, sf_dir, "lineitem").withColumn("date", F.date_trunc("quarter", "l_shipdate"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = lines.groupBy("date", "l_suppkey").agg(
        F.sum("l_extendedprice").alias("sum_price"), F.sum("l_quantity").alias("sum_qty"), F.sum(disc).alias("sum_disc_price"), F.sum(disc * (1 + F.col("l_tax"))).alias("sum_charge"),
        F.avg("l_discount").alias("avg_disc"), F.avg("l_tax").alias("avg_tax"), F.count("*").alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"),
    )
    sector = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("sector"))
    joined = sums.join(sector, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select("date", F.col("l_suppkey").cast("string").alias("ticker"), *[F.round(F.expr(sql), 10).alias(name) for name, sql in RATIOS.items()], "sector")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("symbol"), F.col("value").alias("price"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
