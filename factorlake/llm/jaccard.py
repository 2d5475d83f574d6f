"""N-gram Jaccard join: MinHash banding finds candidates, full shingle sets decide.

1. A pass over the texts gives each document the key of its shingle set and its MinHash bands.
   Documents with equal shingle sets (exact copies among them) collapse into one set, pre-aggregated before the shuffle.
2. Sets are shuffled on band hashes. Buckets of one set go; of buckets with the same members one stays.
3. A second pass makes the shingle sets of those sets alone (a fixed-size filter, then an exact join).
4. Members of a bucket are dealt into blocks, by their number and by their shingles; a task holds two blocks and compares them with
   set arithmetic, so no bucket, however large, sits in one task. A task returns a count for each member and a spanning forest
   of the links it found, never the pairs. A pair that shares several buckets is counted in the smallest only.

No bucket is capped. Work for a cluster of m different texts that all resemble each other is m * m / 2 set comparisons,
spread over (m / block)^2 / 2 tasks; copies cost nothing.

Defined cases: null and empty texts, and texts without words, have no shingles and no links. A text of one to four
words has one shingle, all its words. Rows are told apart by a key of id and text, so null and repeated doc_ids are documents like
others: they are copies of each other only if their shingle sets are equal, and a class of null doc_ids alone has a null class_id.
The result has one row for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Shingles of a block, on average: 16 MB.
BLOCK_SHINGLES = 2_000_000


def banding(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, whose recall at the threshold is reached."""
    for rows in range(max_hashes, 0, -1):
        for bands in range(1, max_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError(f"recall {recall} at {threshold} needs more than {max_hashes} hashes")


def band_hashes(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash bands of several sets at once: values of set i are values[starts[i]:starts[i+1]], none empty."""
    rng = np.random.default_rng(20_240_501)
    factors = rng.integers(1, 2**32, size=(bands, rows), dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 2**32, size=(bands, rows), dtype=np.uint32)
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(starts) - 1, bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(starts) - 1, b + 1, dtype=np.uint64)
            for r in range(rows):
                y = low * factors[b, r] + shifts[b, r]
                y ^= y >> np.uint32(15)  # low bits of a product depend on low bits alone
                h = common.mix(h * np.uint64(0x100000001B3) + np.minimum.reduceat(y, starts[:-1]).astype(np.uint64))
            out[:, b] = h
    return out


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    values, starts = common.shingles(texts, k)
    return [np.unique(values[starts[i] : starts[i + 1]]) for i in range(len(texts))]


def set_key(values: np.ndarray) -> int:
    return common.xxhash.xxh3_64_intdigest(values.tobytes()) - 2**63


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row_key, set_key, size, bands): set_key is a hash of the whole shingle set; null bands and size 0 if there is none."""

    def work(ids: list, texts: list[str]) -> dict:
        sets = shingle_sets(texts, k)
        some = [i for i, s in enumerate(sets) if len(s)]
        keys, sizes, made = [0] * len(ids), [len(s) for s in sets], [None] * len(ids)
        if some:
            flat = np.concatenate([sets[i] for i in some])
            starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])])
            for i, row in zip(some, band_hashes(flat, starts, bands, rows).view(np.int64), strict=True):
                made[i] = row
                keys[i] = set_key(sets[i])
        return {"doc_id": ids, "set_key": keys, "size": sizes, "bands": made}

    return common.map_texts(docs, work, "doc_id long, row_key long, set_key long, size int, bands array<long>", ("row_key",))


def member_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(set_id, shingles) of the sets in members(set_id, row_key), made from the text of that row."""
    wanted = common.key_filter(members.select(F.xxhash64("row_key").alias("h")), "h")
    hashed = docs.select("row_key", "text", F.xxhash64("row_key").alias("h"))

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = common.in_filter(wanted.value, batch.column("h").to_numpy().view(np.uint64))
            if keep.any():
                batch = batch.filter(pa.array(keep))
                ids = batch.column("row_key").to_pylist()
                for lo, hi, texts in common.text_chunks(batch.column("text")):
                    sets = shingle_sets(texts, k)
                    arrays = [pa.array(ids[lo:hi], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["row_key", "set_id", "shingles"])

    made = hashed.mapInArrow(passes, "row_key long, set_id long, shingles array<long>")
    return made.join(members, ["row_key", "set_id"]).dropDuplicates(["set_id"]).select("set_id", "shingles")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections, by columns of shingles that at least two sets share."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], dtype=np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, wide = np.zeros((n, n), dtype=np.float32), 4096
    for lo in range(0, int(shared.sum()), wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        part = np.zeros((n, wide), dtype=np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    total[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return total


def compare(ids: np.ndarray, weights: np.ndarray, sides: np.ndarray, buckets: list[np.ndarray], sets: list[np.ndarray], bucket: int, threshold: float, same: bool) -> tuple[np.ndarray, list]:
    """Links of a task's two blocks: copies linked to each member, and a spanning forest of the links."""
    both = overlaps(sets).astype(np.float64)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if not same:
        linked &= sides[:, None] != sides[None, :]
    counted = linked.copy()
    if max(map(len, buckets)) > 1:  # of several common buckets the smallest counts
        for b in {int(x) for own in buckets for x in own if x < bucket}:
            has = np.array([b in own for own in buckets])
            counted[np.ix_(has, has)] = False
    edges, seen = [], np.zeros(len(ids), dtype=bool)
    for root in range(len(ids)):
        if not seen[root]:
            seen[root], reach = True, [root]
            while reach:
                at = reach.pop()
                new = np.flatnonzero(linked[at] & ~seen)
                seen[new] = True
                edges += [(int(ids[at]), int(ids[x])) for x in new]
                reach += new.tolist()
    return counted @ weights, edges


def verified(blocks: DataFrame, threshold: float) -> DataFrame:
    """Rows (set_id, links, peer) of blocks sorted by (bucket, i, j): counts have a null peer, forest edges null links."""

    def close(group: list) -> tuple[list, list, list]:
        bucket, i, j = group[0][:3]
        group = sorted(group, key=lambda r: r[3])
        ids = np.array([r[3] for r in group], dtype=np.int64)
        weights = np.array([r[4] for r in group], dtype=np.int64)
        counts, edges = compare(ids, weights, np.array([r[5] for r in group]), [np.asarray(r[6]) for r in group], [r[7].view(np.uint64) for r in group], bucket, threshold, i == j)
        held = np.flatnonzero(counts)
        return [*ids[held].tolist(), *(a for a, _ in edges)], [*counts[held].tolist(), *[None] * len(edges)], [*[None] * len(held), *(b for _, b in edges)]

    def batch_of(made: tuple[list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["set_id", "links", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, made = None, [], ([], [], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "set_id", "copies", "side")]
            lists = [[x.values.to_numpy() for x in batch.column(c)] for c in ("buckets", "shingles")]
            for row in zip(*columns, *lists, strict=True):
                if row[:3] != key:
                    if len(group) > 1:
                        for x, y in zip(made, close(group), strict=True):
                            x += y
                    key, group = row[:3], []
                    if len(made[0]) > 10_000:
                        yield batch_of(made)
                        made = ([], [], [])
                group.append(row)
        if len(group) > 1:
            for x, y in zip(made, close(group), strict=True):
                x += y
        yield batch_of(made)

    return blocks.mapInArrow(run, "set_id long, links long, peer long")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, class_id, n_links, n_copies).

    class_id is the smallest doc_id of the documents connected by links (Jaccard of shingle sets at least threshold);
    n_links counts the other documents linked directly, n_copies those of them with the very same shingle set.
    """
    return keyed_classes(common.keyed_rows(docs, id_col, text_col), threshold, k, recall, block).select("doc_id", "class_id", "n_links", "n_copies")


def keyed_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999, block: int = 256) -> DataFrame:
    """jaccard_classes of keyed rows, with row_key and with component, a key of the class (null for a text without words)."""
    bands, rows = banding(threshold, recall)
    signed = common.cut(signatures(docs, k, bands, rows))
    sets = common.cut(signed.where("size > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.max("size").alias("n_shingles"), F.count("*").alias("copies")))
    first = signed.where("size > 0").join(sets.drop("doc_id"), ["set_key", "row_key"]).dropDuplicates(["set_key"]).withColumnRenamed("set_key", "set_id")
    found = first.select("set_id", "copies", "n_shingles", F.explode("bands").alias("bucket"))
    by_bucket = found.groupBy("bucket").agg(F.count("*").alias("members"), F.min("set_id").alias("low"), F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("mark"), F.sum("n_shingles").alias("weight")).where("members > 1")
    kept = common.cut(by_bucket.groupBy("members", "low", "mark").agg(F.min("bucket").alias("bucket"), F.max("weight").alias("weight")))  # same members, same pairs
    large = kept.where(F.col("members") > max(sets.count() * bands // common.HOT_SHARE, common.HOT_SHARE // 10)).select("bucket")  # HOT_SHARE buckets at most
    members = common.cut(common.join_split(found, kept.select("bucket", "members", "weight"), ["bucket"], large))
    named = members.groupBy("set_id").agg(F.collect_list("bucket").alias("buckets"), F.first("copies").alias("copies"))
    named = named.join(sets.select(F.col("set_key").alias("set_id"), "row_key"), "set_id")
    shingled = member_sets(docs, named.select("set_id", "row_key"), k)
    dealt = members.select("set_id", "bucket", F.ceil(F.greatest(F.col("members") / block, F.least(F.col("members"), F.col("weight") / BLOCK_SHINGLES))).cast("int").alias("blocks")).withColumn("own", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "set_id", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    rows_of = dealt.join(named.join(shingled, "set_id").select("set_id", "copies", "buckets", "shingles"), "set_id")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = rows_of.select("bucket", "i", "j", "set_id", "copies", "side", "buckets", "shingles").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    links = common.cut(verified(blocks, threshold))
    counts = links.where("peer is null").groupBy("set_id").agg(F.sum("links").alias("links"))
    classes = common.components(links.where("peer is not null").select(F.col("set_id").alias("a"), F.col("peer").alias("b")))
    joined = sets.join(classes.select(F.col("node").alias("set_key"), "component"), "set_key", "left").join(counts.withColumnRenamed("set_id", "set_key"), "set_key", "left")
    joined = joined.select("set_key", F.coalesce("component", "set_key").alias("component"), "doc_id", (F.col("copies") - 1).alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    lookup = joined.drop("doc_id").join(joined.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component")
    # empty texts carry no key, so they don't meet in one task of the join
    keyed = signed.select("doc_id", "row_key", F.when(F.col("size") > 0, F.col("set_key")).alias("set_key")).where("set_key is not null")
    zero = F.lit(0).cast("long")
    empty = signed.where("size = 0").select("doc_id", "row_key", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_copies"))
    return keyed.join(lookup, "set_key").select("doc_id", "row_key", "component", "class_id", "n_links", "n_copies").unionByName(empty)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without all but one document of each class: the one with the smallest doc_id stays.

    A null doc_id comes after all others; of different texts with the smallest doc_id, or of null ones alone, that with the smallest
    row key stays. Of rows that repeat a doc_id, null too, and a text one stays; so do documents without words.
    """
    classes = keyed_classes(common.keyed_rows(docs), **options)
    worded = classes.where("component is not null and doc_id <=> class_id").groupBy("component").agg(F.min("row_key").alias("_kept")).select("_kept")
    kept = worded.unionByName(classes.where("component is null").select(F.col("row_key").alias("_kept")).distinct())
    return common.rows_in(docs, kept, "left_semi", once=True)
