"""A stored keyed table: hash buckets as folders, changes that rewrite only the buckets they touch, and commits that a retry can repeat.

    <path>/data/commit=<n>/bucket=<b>/...   the rows of bucket b as of commit n
    <path>/commits/commit=<n>/...           one file: the commit's change id and, for every bucket, the commit that holds its rows

A change reads the buckets of its keys, writes their new rows under the next commit's number and then the commit's one file; what readers see is
the largest commit with a file. A writer that dies before leaves rows that no commit names; the same change again writes over them. A change id
that a commit already names is not applied again. One writer at a time; readers keep the commit they opened, as no file of it is ever changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from factorlake.operators import tables

COMMITS = "change string, bucket int, held long"


class KeyedStore:
    """Rows of ``schema`` with the columns ``key`` as their key, over ``buckets`` hash buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], buckets: int = 64):
        from pyspark.sql.types import _parse_datatype_string

        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def commits(self) -> DataFrame:
        """(change, bucket, held, commit): for each commit a row a bucket with rows, and one without a bucket."""
        try:
            return self.spark.read.schema(f"{COMMITS}, commit long").parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], f"{COMMITS}, commit long")

    def state(self) -> tuple[int, dict[int, int]]:
        """(last commit, the commit that holds each bucket's rows); as many rows as buckets."""
        commits = self.commits()
        last = commits.agg(F.max("commit")).first()[0]
        if last is None:
            return 0, {}
        return last, {r["bucket"]: r["held"] for r in commits.where((F.col("commit") == last) & F.col("bucket").isNotNull()).collect()}

    def rows(self, held: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/commit={commit}/bucket={bucket}" for bucket, commit in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self.rows(self.state()[1])

    def get(self, **key) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        wanted = self.spark.range(1).select(*[F.lit(key[c]).cast(self.schema[c].dataType).alias(c) for c in self.key])
        bucket = wanted.select(self.bucket()).first()[0]
        return tables.get_by_key(self.rows({b: c for b, c in self.state()[1].items() if b == bucket}), **key)

    def change(self, change_id: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replace the touched buckets' rows by apply(their rows, changes); False if the change is already in a commit."""
        if not self.commits().where(F.col("change") == change_id).isEmpty():
            return False
        last, held = self.state()
        touched = {r[0] for r in changes.select(self.bucket()).distinct().collect()}  # at most as many as buckets
        now = apply(self.rows({b: c for b, c in held.items() if b in touched}), changes)
        folder = f"{self.path}/data/commit={last + 1}"
        now = now.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("bucket", self.bucket())
        now.repartition("bucket").sortWithinPartitions("bucket", *self.key).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = {r[0] for r in self.spark.read.schema(StructType([*self.schema, *_bucket()])).parquet(folder).select("bucket").distinct().collect()}
        self.commit(last + 1, change_id, {b: c for b, c in held.items() if b not in touched} | dict.fromkeys(written, last + 1))
        return True

    def commit(self, number: int, change_id: str, held: dict[int, int]) -> None:
        rows = [(change_id, None, None), *((change_id, b, c) for b, c in sorted(held.items()))]
        self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/commit={number}")

    def upsert(self, change_id: str, changes: DataFrame, version: str | None = None) -> bool:
        names = [f.name for f in self.schema]
        return self.change(change_id, changes, lambda table, rows: tables.upsert_by_key(table, rows, self.key, version).select(*names))

    def insert_if_absent(self, change_id: str, rows: DataFrame) -> bool:
        return self.change(change_id, rows, lambda table, new: tables.insert_if_absent(table, new.select(*table.columns), self.key))

    def update(self, change_id: str, values: DataFrame) -> bool:
        return self.change(change_id, values, lambda table, new: tables.update_by_key(table, new, self.key))

    def delete(self, change_id: str, keys: DataFrame) -> bool:
        return self.change(change_id, keys, lambda table, gone: tables.delete_by_key(table, gone, self.key))


def _bucket() -> StructType:
    return StructType().add("bucket", "integer")
