"""Vectors: deterministic embeddings, nearest neighbours, near-duplicates, retrieval measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from factorlake.functions.scalar import norm
from factorlake.operators.tables import upsert_by_key


def hash_embedding(text: Column, size: int = 16) -> Column:
    """A unit vector made of md5 digests of the text and a counter."""
    parts = F.array(*[F.conv(F.substring(F.md5(F.concat(text, F.lit(f"#{i}"))), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1.0 for i in range(size)])
    return F.transform(parts, lambda x: x / F.nullif(norm(parts), F.lit(0.0)))


#: Vectors, and queries, of a block at most, about; score cells that a task holds at a time.
VECTORS, QUERIES, CELLS = 65_536, 8_192, 4_000_000


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the lists as rows, which of them are lists of ``width`` numbers; the others are rows of zeros)."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64) if len(column) else np.zeros(0)
    made, at = np.zeros((len(column), width)), np.repeat(np.arange(len(column)), lengths)
    starts = np.cumsum(lengths) - lengths
    made[at, np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    good = (lengths == width) & ~np.isnan(made).any(axis=1)
    made[~good] = 0.0
    return made, good


def _ordered_sum(rows: np.ndarray) -> np.ndarray:
    """Sums of rows, added from left to right as the engine does, so that equal vectors have equal scores."""
    total = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        total += rows[:, d]
    return total


def _block_best(held: pa.Table, asked: pa.Table, k: int, euclidean: bool, others: bool, schema: pa.Schema) -> pa.Table:
    """The k best vectors of a block for each query of another: a matrix product finds who may be among them, within a margin, and their scores are then taken in full."""
    if not len(held) or not len(asked):
        return schema.empty_table()
    held = held.sort_by("vec_id")
    width = max(pc.max(pc.list_value_length(t.column(c))).as_py() or 0 for t, c in ((held, "v"), (asked, "q")))
    (v, fine), (q, sound) = _matrix(held.column("v"), width), _matrix(asked.column("q"), width)
    vv, qq = np.sqrt(_ordered_sum(v * v)), np.sqrt(_ordered_sum(q * q))
    whole = np.where(vv > 0, vv, 1.0), np.where(qq > 0, qq, 1.0)
    unit = v if euclidean else v / whole[0][:, None]
    ids, asked_ids = held.column("vec_id").combine_chunks(), asked.column("query_id").combine_chunks().cast(held.schema.field("vec_id").type)
    distinct = pc.unique(ids)
    code, own = pc.index_in(ids, distinct).to_numpy(), pc.fill_null(pc.index_in(asked_ids, distinct), -1).to_numpy()
    first, last = np.searchsorted(code, own), np.searchsorted(code, own, side="right")
    step, parts = max(CELLS // len(v), 1), []
    for lo in range(0, len(q), step):
        part = slice(lo, lo + step)
        if euclidean:
            key, scale = (vv * vv)[None, :] - 2 * q[part] @ v.T, (vv.max() + qq[part]) ** 2  # less the query's own square
            key[:, ~fine], key[~sound[part]] = np.inf, np.inf
        else:
            key, scale = -(q[part] / whole[1][part, None]) @ unit.T, np.ones(len(q[part]))
        if others:
            for i, (a, b) in enumerate(zip(first[part], last[part], strict=True)):
                key[i, a:b] = np.nan
        kth = np.partition(key, min(k, key.shape[1]) - 1, axis=1)[:, min(k, key.shape[1]) - 1]
        kth = np.where(np.isnan(kth), np.inf, kth) + 1e-11 * scale
        i, j = np.nonzero(key <= kth[:, None])
        score = np.empty(len(i))
        for at in range(0, len(i), 100_000):
            x, y = q[lo + i[at : at + 100_000]], v[j[at : at + 100_000]]
            if euclidean:
                score[at : at + 100_000] = np.sqrt(_ordered_sum((x - y) * (x - y)))
            else:
                size = qq[lo + i[at : at + 100_000]] * vv[j[at : at + 100_000]]
                score[at : at + 100_000] = np.where(size > 0, _ordered_sum(x * y) / np.where(size > 0, size, 1.0), 0.0)
        lost = ~(fine[j] & sound[lo + i])
        score[lost] = np.inf if euclidean else 0.0
        order = np.lexsort((j, score if euclidean else -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, score = (z[place < k] for z in (i, j, score))
        names = asked.column("query_id").combine_chunks().take(pa.array(lo + i))
        parts.append(pa.table({"query_id": names, "vec_id": ids.take(pa.array(j)), "score": pa.array(score, mask=np.isinf(score))}))
    return pa.concat_tables(parts)


def _best(queries: DataFrame, vectors: DataFrame, k: int, euclidean: bool, others: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, vec_id, score): of queries (query_id, q) at least the k best vectors (vec_id, v) among those with the same keys.

    Both sides are dealt into blocks by their ids and every block of vectors meets every block of queries in a task of its own, as a matrix product;
    each sends its k best of a query.
    """
    n, asked = vectors.count(), queries.count()
    vb, qb = max(-(-n // VECTORS), min(-(-n // 2048), 32), 1), max(-(-asked // QUERIES), 1)
    deal = lambda df, c, own, parts, other, rest: df.withColumn(own, F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(rest - 1))))
    left, right = deal(vectors, "vec_id", "vb", vb, "qb", qb), deal(queries, "query_id", "qb", qb, "vb", vb)
    made = StructType([queries.schema["query_id"], vectors.schema["vec_id"], StructField("score", DoubleType())])
    schema = to_arrow_schema(made)
    run = lambda held, asked: _block_best(held, asked, k, euclidean, others, schema).cast(schema)
    group = [*keys, "vb", "qb"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(lambda held, asked: run(held, asked), made)


def _ranked(found: DataFrame, k: int, largest: bool) -> DataFrame:
    best = F.desc("score") if largest else F.asc_nulls_last("score")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id"))).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def knn_l2(queries: DataFrame, vectors: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by Euclidean distance; queries (query_id, q), vectors (vec_id, v). Null where one has no numbers or the sizes differ, and last."""
    return _ranked(_best(queries, vectors, k, euclidean=True), k, largest=False)


def knn_cosine(queries: DataFrame, vectors: DataFrame, k: int = 20, others: bool = False) -> DataFrame:
    """The k best by cosine, 0 where there is none; with ``others`` none is its own neighbour."""
    return _ranked(_best(queries, vectors, k, euclidean=False, others=others), k, largest=True)


def near_duplicate(candidates: DataFrame, registry: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(query_id, max_similarity, duplicate): against all of a registry but the candidate itself; an empty one gives 0."""
    best = knn_cosine(candidates, registry, 1, others=True).select("query_id", F.col("score").alias("m"))
    joined = candidates.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("m", F.lit(0.0)).alias("max_similarity"))
    return joined.withColumn("duplicate", F.col("max_similarity") > threshold)


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int, bucket: float = 2.0, tables: int = 4, seed: int = 7) -> DataFrame:
    """Approximate Euclidean neighbours by random projections; queries and vectors as above, of dense arrays.

    Vectors and queries of one bucket of a table meet in blocks; each block sends its k best of a query, so pairs never leave a task as rows.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    as_vector = lambda c: array_to_vector(F.col(c).cast("array<double>"))
    left, right = queries.where("q is not null").withColumn("x", as_vector("q")), vectors.where("v is not null").withColumn("x", as_vector("v"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(right)
    placed = lambda df, *kept: model.transform(df).select(*kept, F.posexplode(F.transform("h", lambda v: vector_to_array(v)[0])).alias("table", "bucket"))
    found = _best(placed(left, "query_id", "q"), placed(right, "vec_id", "v"), k, euclidean=True, keys=("table", "bucket"))
    return _ranked(found.dropDuplicates(["query_id", "vec_id"]), k, largest=False)


def vector_upsert(index: DataFrame, chunks: DataFrame, key: str = "chunk_id", version: str | None = None) -> DataFrame:
    """The index with the chunks in place of those it holds under the same key; text, vector and metadata go along. A column that only one side has is null for the other's rows."""
    made = upsert_by_key(index, chunks, [key], version)
    return made.drop(version) if version and version not in index.columns else made


def precision_recall_mrr(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, rr) at k; ranked (query_id, vec_id, rank), relevant (query_id, vec_id). Averages are the caller's ``agg``."""
    marked = ranked.join(relevant.withColumn("relevant", F.lit(True)), ["query_id", "vec_id"], "left")
    return measures(marked, relevant.groupBy("query_id").agg(F.count("*").alias("all")), k)


def label_precision_recall_mrr(ranked: DataFrame, labels: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The same where a vector is relevant to the queries of its label, labels (vec_id, label), wanted (query_id, label): counted by label, so no pair of a query and a vector is made that isn't ranked."""
    marked = ranked.join(labels, "vec_id").join(wanted.select("query_id", F.col("label").alias("asked")), "query_id")
    totals = wanted.join(labels.groupBy("label").agg(F.count("*").alias("all")), "label")
    return measures(marked.withColumn("relevant", F.col("label") == F.col("asked")), totals.select("query_id", "all"), k)


def measures(marked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, rr) at k; marked (query_id, rank, relevant), totals (query_id, all)."""
    sums = marked.where(F.col("rank") <= k).groupBy("query_id").agg(F.count(F.when(F.col("relevant"), 1)).alias("hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    joined = sums.join(totals, "query_id", "left")
    return joined.select("query_id", (F.col("hits") / F.lit(float(k))).alias("precision"), F.coalesce(F.col("hits") / F.col("all"), F.lit(0.0)).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def union_chunks_distinct(*results: DataFrame) -> DataFrame:
    """Results (chunk_id, ...) in order of the lists, each chunk where it stands first."""
    whole = None
    for order, df in enumerate(results):
        part = df.withColumn("_order", F.lit(order))
        whole = part if whole is None else whole.unionByName(part)
    at = F.row_number().over(Window.partitionBy("chunk_id").orderBy("_order", F.desc("score")))
    return whole.withColumn("_at", at).where("_at = 1").drop("_at", "_order")


def semi_relevant(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    return ranked.join(relevant, "chunk_id", "left_semi")
