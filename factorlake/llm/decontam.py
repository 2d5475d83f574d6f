"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Jaccard similarity of a short test item and a long document is near zero even if the item lies in the document whole,
so signatures of documents are no use. The search therefore samples the small side: an item's sketch is the
hashes of its shingles that are smallest under each of several hash functions, and a document is a candidate if it
contains one of them. If a share c of the item lies in the document, each sketch value hits with probability c.
Items are partitioned by their number of shingles, and each partition has a sketch length of its own: the shortest
whose recall at the threshold, over the containments that a set of this size can have, meets the target.

A pass over the documents keeps those with a sketch value (by a filter of fixed size, whatever the number of items);
hits are joined to the sketches with hot values and items salted, since a passage may occur in a third of all documents;
candidates are verified on whole shingle sets, both joined by key.

Defined cases: null and empty documents contain nothing; items without words are never found; an item of fewer than
five words is found where a document has exactly its words and no more. Rows are told apart by a key of id and text, items by
their shingle set, so null and repeated ids are searched like others. ``contamination`` has one result row for each pair
of ids, null too: of rows that repeat the ids, the pair with the largest containment. ``decontaminate`` judges each row by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .jaccard import set_key, shingle_sets


def sketch_length(partition: int, threshold: float, recall: float) -> int:
    """Hash functions for items of at most 2**partition shingles.

    Sketch values drawn with replacement from n shingles all miss with probability (1 - c)^m. With few shingles
    c is a multiple of 1/n, so the least containment that passes the threshold may be larger than it.
    """
    n = 2**partition
    least = ceil(threshold * n - 1e-9) / n
    return n if least >= 1 or n <= 4 else min(n, max(4, ceil(log(1 - recall) / log(1 - least))))


def item_sketches(items: DataFrame, threshold: float, recall: float, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item_key, n, partition, sketch, shingles), one row for each item with words; item_key is a hash of its shingle set."""
    rows = common.text_rows(items, id_col, text_col)

    def work(ids: list, texts: list[str]) -> dict:
        out = {"item_id": [], "item_key": [], "n": [], "partition": [], "sketch": [], "shingles": []}
        for item, values in zip(ids, shingle_sets(texts, k), strict=True):
            if len(values):
                partition = int(len(values) - 1).bit_length()
                with np.errstate(over="ignore"):
                    ranks = (common.mix(values ^ common.mix(np.uint64([f + 1]))) for f in range(sketch_length(partition, threshold, recall)))
                    sketch = np.unique([values[r.argmin()] for r in ranks])
                for column, value in zip(out, (item, set_key(values), len(values), partition, sketch.view(np.int64), values.view(np.int64)), strict=True):
                    out[column].append(value)
        return out

    made = common.map_texts(rows, work, "item_id long, item_key long, n int, partition int, sketch array<long>, shingles array<long>")
    return made.dropDuplicates(["item_id", "item_key"])


def documents_with_hits(docs: DataFrame, sketches: DataFrame, k: int) -> DataFrame:
    """(doc_id, row_key, hits, shingles) of documents with at least one shingle that passes the filter over all sketches."""
    wanted = common.key_filter(sketches, "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist()
            for lo, hi, texts in common.text_chunks(batch.column("text")):
                values, starts = common.shingles(texts, k)
                hit = common.in_filter(wanted.value, values)
                counts = np.concatenate([[0], np.cumsum(hit)])
                rows = np.flatnonzero(counts[starts[1:]] > counts[starts[:-1]])
                if len(rows):
                    hits = [np.unique(values[a:b][hit[a:b]]).view(np.int64) for a, b in zip(starts[rows], starts[rows + 1], strict=True)]
                    whole = [np.unique(values[a:b]).view(np.int64) for a, b in zip(starts[rows], starts[rows + 1], strict=True)]
                    arrays = [pa.array([ids[lo + r] for r in rows], pa.int64()), pa.array([keys[lo + r] for r in rows], pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(whole, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "hits", "shingles"])

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key long, hits array<long>, shingles array<long>")


def contaminated_rows(docs: DataFrame, items: DataFrame, threshold: float = 0.8, recall: float = 0.999, k: int = 5, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, item_id, n_shingles, n_found, containment) of keyed rows that hold at least threshold of an item's shingles."""
    sketched = common.cut(item_sketches(items, threshold, recall, k, item_col, text_col))
    sketches = sketched.select("item_key", F.explode("sketch").alias("value")).distinct()
    found = common.cut(documents_with_hits(docs, sketches, k))
    hits = found.select("row_key", F.explode("hits").alias("value"))
    met = common.join_salted(hits, sketches, ["value"], "row_key", hits.count())
    candidates = common.cut(met.groupBy("row_key", "item_key").agg(F.count("*").alias("sketch_hits")))
    whole = sketched.select("item_key", "item_id", "n", F.col("shingles").alias("item_shingles"))
    by_item = common.join_salted(candidates, whole, ["item_key"], "row_key", candidates.count())
    pairs = by_item.join(found.select("row_key", "doc_id", "shingles"), "row_key")  # by document no key is hot
    counted = pairs.select("doc_id", "row_key", "item_id", F.col("n").alias("n_shingles"), F.size(F.array_intersect("item_shingles", "shingles")).alias("n_found"))
    return counted.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= threshold)


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, recall: float = 0.999, k: int = 5, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_found, containment): documents that hold at least threshold of an item's shingles."""
    rows = contaminated_rows(common.keyed_rows(docs, id_col, text_col), items, threshold, recall, k, item_col, text_col)
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shingles", "n_found")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_shingles", "best.n_found", "best.containment")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no item is found."""
    bad = contaminated_rows(common.keyed_rows(docs), items, **options).select("row_key").distinct()
    return common.rows_in(docs, bad, "left_anti")
