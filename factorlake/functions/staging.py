"""Intermediate tables: written to the folder the session shares, so lost executors lose nothing and plans stay short."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the one set on the context; only where neither is set, as in tests, a new temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Plans made and run meanwhile remove their shuffle files as they end; for those whose rows are stored, so that nothing reads the files again."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from there on; the shuffle files it took are gone."""
    shared_folder(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)
