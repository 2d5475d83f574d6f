"""Nearest neighbours through an inverted file: vectors lie in the cell of their nearest centroid, a query reads only the cells nearest to it.

Centroids are fitted on at most ``sample`` vectors; every vector is placed. Within the cells that a query probes all vectors are ranked by
their exact distance. What the index can miss are neighbours in cells that are not probed: ``recall`` measures it against all vectors.

A cell with more than ``BLOCK`` vectors, or probed by more than that many queries, is cut into blocks by hash, and every block of vectors meets every
block of the cell's queries in a task of its own, so no task grows with a cell. Each sends its k best of a query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.staging import shared_folder

#: Vectors, and queries, that a task compares at most, about.
BLOCK = 50_000


@dataclass(frozen=True)
class InvertedFile:
    """``vectors`` (vec_id, v, cell) as stored, ``centroids`` as a matrix whose size no input changes."""

    vectors: DataFrame
    centroids: np.ndarray


def matrix_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)


def nearest_cells(df: DataFrame, vector: str, centroids: np.ndarray, cells: int) -> DataFrame:
    """df with ``cells``: the numbers of the nearest centroids, nearest first."""
    sent = df.sparkSession.sparkContext.broadcast(centroids)
    schema = df.withColumn("cells", F.array().cast("array<int>")).schema

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            order = np.argsort(squared_distances(matrix_of(batch.column(vector)), sent.value), axis=1, kind="stable")[:, :cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([*order.astype(np.int32)], pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return df.mapInArrow(run, schema)


def build(vectors: DataFrame, cells: int = 256, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> InvertedFile:
    """The index of vectors (vec_id, v), written to the shared folder by cell; null vectors are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from uuid import uuid4

    rows = vectors.where("v is not null").select("vec_id", F.col("v").cast("array<double>").alias("v"))
    some = rows.orderBy(F.xxhash64("vec_id")).limit(sample).select(array_to_vector("v").alias("features"))
    centroids = np.array(KMeans(k=cells, maxIter=rounds, seed=seed).fit(some).clusterCenters()) if not some.isEmpty() else np.zeros((1, 1))
    path = f"{shared_folder(vectors.sparkSession)}/inverted-{uuid4().hex}"
    placed = nearest_cells(rows, "v", centroids, 1).select("vec_id", "v", F.col("cells")[0].alias("cell"))
    placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").parquet(path)
    stored = vectors.sparkSession.read.schema("vec_id long, v array<double>, cell int").parquet(path)
    return InvertedFile(stored, centroids)


def search(index: InvertedFile, queries: DataFrame, k: int = 15, probes: int = 32) -> DataFrame:
    """(query_id, vec_id, score, rank): of queries (query_id, q) the k nearest vectors by Euclidean distance in the cells probed."""
    probed = nearest_cells(queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q")), "q", index.centroids, probes)
    probed = probed.select("query_id", "q", F.explode("cells").alias("cell"))
    sizes = index.vectors.groupBy("cell").agg(F.count("*").alias("n")).join(probed.groupBy("cell").agg(F.count("*").alias("asked")), "cell")
    blocks = F.broadcast(sizes.select("cell", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(f"_{c}") for c in ("n", "asked")]))  # a row a cell
    own = lambda c, parts: F.pmod(F.xxhash64(c), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = index.vectors.join(blocks, "cell").withColumn("vb", own("vec_id", "_n")).withColumn("qb", every("_asked")).select("cell", "vb", "qb", "vec_id", "v")
    right = probed.join(blocks, "cell").withColumn("qb", own("query_id", "_asked")).withColumn("vb", every("_n")).select("cell", "vb", "qb", "query_id", "q")

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names = held.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
        v, q, made = matrix_of(held.column("v")), matrix_of(asked.column("q")), [[], [], []]
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order] if len(v) else v
        for lo in range(0, len(names) if len(ids) else 0, 256):
            near = squared_distances(q[lo : lo + 256], v)
            at = np.argsort(near, axis=1, kind="stable")[:, :k]
            exact = np.sqrt(((q[lo : lo + 256, None, :] - v[at]) ** 2).sum(axis=2))
            for out, x in zip(made, (np.repeat(names[lo : lo + 256], at.shape[1]), ids[at].ravel(), exact.ravel()), strict=True):
                out.append(x)
        columns = [np.concatenate(x) if x else np.zeros(0) for x in made]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    key = ["cell", "vb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, "query_id long, vec_id long, score double")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", at).where(F.col("rank") <= k)


def share_read(index: InvertedFile, queries: DataFrame, probes: int = 32) -> float:
    """Of all (query, vector) pairs the share that a search compares."""
    probed = nearest_cells(queries.select("query_id", F.col("q").cast("array<double>").alias("q")), "q", index.centroids, probes).select(F.explode("cells").alias("cell"))
    sizes = index.vectors.groupBy("cell").agg(F.count("*").alias("n"))
    pairs = probed.groupBy("cell").agg(F.count("*").alias("asked")).join(sizes, "cell").agg(F.sum(F.col("asked") * F.col("n"))).first()[0] or 0
    return pairs / max(queries.count() * index.vectors.count(), 1)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (query_id, vec_id) that were found."""
    total = exact.count()
    return found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0
