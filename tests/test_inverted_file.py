"""The inverted file: all cells probed equal exact search, blocks of hot cells, recall on the given vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import inverted_file as I
from factorlake.operators import vector
from factorlake.sources import derived


def rows_of(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<double>")


def asked(vectors, every=10):
    return vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def key(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("block", [I.BLOCK, 7])
def test_all_cells_probed_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(120, 8)), np.tile(r.normal(size=(1, 8)), (60, 1))])  # a third are copies, in one cell
    vectors = rows_of(spark, x)
    index = I.build(vectors, cells=5)
    assert index.vectors.count() == 180
    assert key(I.search(index, asked(vectors), k=4, probes=5)) == key(vector.knn_l2(asked(vectors), vectors, 4))


def test_recall_and_share_on_the_given_vectors(spark):
    rows = derived.vectors(spark, "/root/testdata/sf0.01")
    vectors = rows.select("vec_id", F.col("embedding").alias("v"))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    index = I.build(vectors, cells=32)
    found = I.search(index, queries, k=15, probes=16).cache()
    assert I.recall(found, vector.knn_l2(queries, vectors, 15)) >= 0.9
    assert 0 < I.share_read(index, queries, probes=16) < 0.75


def test_empty_and_null_vectors(spark):
    none = rows_of(spark, [])
    assert I.search(I.build(none), asked(none)).count() == 0
    some = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 2.0])], "vec_id long, v array<double>")
    found = I.search(I.build(some, cells=2), some.selectExpr("vec_id as query_id", "v as q"), k=5, probes=2)
    assert key(found) == [(1, 1, 1, 0.0), (1, 2, 3, 1.0), (3, 1, 3, 0.0), (3, 2, 1, 1.0)]
