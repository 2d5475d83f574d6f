"""Nearest neighbours by blocks: the same rows as all pairs, and no row for a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.operators import vector


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(22)
    rows = r.normal(size=(300, 6)).astype(np.float32)
    rows[100:160] = rows[40]  # ties, more than k
    rows[7] = 0.0
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, v array<float>")
    return rows.astype(float), vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def best(rows, score, k, largest=False, others=False):
    made = {}
    for q in range(0, len(rows), 20):
        order = sorted((i for i in range(len(rows)) if not (others and i == q)), key=lambda i: (-score(q, i) if largest else score(q, i), i))
        made[q] = order[:k]
    return made


def found(df):
    made = {}
    for x in sorted(df.collect(), key=lambda x: (x.query_id, x.rank)):
        made.setdefault(x.query_id, []).append(x.vec_id)
    return made


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    for name, n in (("VECTORS", 70), ("QUERIES", 4), ("CELLS", 200)):
        monkeypatch.setattr(vector, name, n, raising=False)


def no_pairs(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("NestedLoopJoin", "CartesianProduct", "SortMergeJoin", "BroadcastHashJoin"))


def test_euclidean(tables):
    rows, vectors, queries = tables
    made = vector.knn_l2(queries, vectors, 9)
    assert no_pairs(made) and found(made) == best(rows, lambda q, i: float(np.sqrt(((rows[q] - rows[i]) ** 2).sum())), 9)


def test_cosine_and_others(tables):
    rows, vectors, queries = tables
    size = np.sqrt((rows * rows).sum(axis=1))
    score = lambda q, i: float(round((rows[q] * rows[i]).sum() / (size[q] * size[i]), 13)) if size[q] * size[i] else 0.0
    made = vector.knn_cosine(queries, vectors, 9, others=True)
    assert no_pairs(made) and found(made) == best(rows, score, 9, largest=True, others=True)


def test_vectors_without_numbers(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [-1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, v array<double>")
    queries = vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    assert [(x.vec_id, x.score) for x in vector.knn_cosine(queries, vectors, 4).orderBy("rank").collect()] == [(0, 1.0), (1, 0.0), (3, 0.0), (2, -1.0)]
    assert [x.vec_id for x in vector.knn_l2(queries, vectors, 4).orderBy("rank").collect()] == [0, 2, 3, 1]


def test_lsh_makes_no_row_for_a_pair(tables):
    rows, vectors, queries = tables
    made = vector.knn_lsh(queries, vectors, 5, bucket=1e6)  # one bucket or two: nearly all
    assert no_pairs(made)
    want = best(rows, lambda q, i: float(np.sqrt(((rows[q] - rows[i]) ** 2).sum())), 5)
    got = found(made)
    assert all(len(v) == 5 and len(set(v)) == 5 for v in got.values()) and sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_measures_by_label(spark, tables):
    _, vectors, queries = tables
    labels = vectors.select("vec_id", F.when(F.col("vec_id") % 7 > 0, F.col("vec_id") % 7).cast("int").alias("label"))
    wanted = labels.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    ranked = vector.knn_cosine(queries, vectors, 9).localCheckpoint()
    made = vector.label_precision_recall_mrr(ranked, labels, wanted, 9)
    pairs = vector.precision_recall_mrr(ranked, labels.join(wanted, "label").select("query_id", "vec_id"), 9)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, pairs.collect()))
