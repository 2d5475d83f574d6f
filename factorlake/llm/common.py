"""Small helpers shared by the text operators: table access, word shingles, fixed-size key filters, components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Distinct words whose hashes a task keeps; the cache is emptied beyond that, so its memory is bounded.
CACHED_WORDS = 500_000
#: Characters of text that a task works on at once.
CHUNK_CHARS = 1_000_000
#: Texts that a task works on at once, however short they are.
CHUNK_TEXTS = 50_000
#: log2 of the bits of a key filter: 2 MB, whatever the number of keys.
FILTER_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so other columns of the input, whatever their names, do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of a row's id, null or not, and its whole text (null: empty): never null, and its own where ids are missing or repeat."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_rows with ``row_key``."""
    return text_rows(docs, id_col, text_col).withColumn("row_key", row_key())


def rows_in(docs: DataFrame, keys: DataFrame, how: str, once: bool = False) -> DataFrame:
    """The rows of docs whose row key is (left_semi) or isn't (left_anti) in the only column of keys; its name can't be one of docs'.

    ``once``: of rows with the same doc_id and text one stays; they meet where the join put them by the key, so texts are not shuffled again.
    """
    name = f"key_{uuid4().hex}"
    joined = docs.withColumn(name, row_key()).join(keys.toDF(name), name, how)
    return (joined.dropDuplicates([name, "doc_id", "text"]) if once else joined).drop(name)


def map_texts(df: DataFrame, work: Callable[[list, list[str]], dict], schema: str, carried: tuple[str, ...] = (), chars: int = CHUNK_CHARS) -> DataFrame:
    """Apply ``work(ids, texts) -> columns`` to chunks of rows of (doc_id, text) that hold about ``chars`` characters.

    A chunk never spans two Arrow batches; one very long text makes a chunk of its own. Columns ``carried`` go along as they
    are, for work that returns one row for each text.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, texts in text_chunks(batch.column("text"), chars):
                made = work(ids[lo:hi], texts) | {c: batch.column(c).slice(lo, hi - lo).to_pylist() for c in carried}
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return df.select("doc_id", "text", *carried).mapInArrow(run, schema)


def text_chunks(column: pa.Array, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    lo, held, texts = 0, 0, []
    for i, value in enumerate(column):
        text = value.as_py()
        texts.append(text)
        held += len(text)
        if held >= chars or len(texts) >= CHUNK_TEXTS:
            yield lo, i + 1, texts
            lo, held, texts = i + 1, 0, []
    if texts:
        yield lo, len(column), texts


class WordHashes(dict):
    """64-bit hashes of words; a word is hashed once while it stays cached."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


WORD_HASHES = WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and where each text's shingles begin (one more at the end).

    Words are runs of letters, digits and underscores in lower case. A text of fewer than k words, but
    at least one, has a single shingle: all its words. A text without words has none.
    """
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        counts[i] = n = len(words)
        parts.append(np.fromiter(map(WORD_HASHES.__getitem__, words), dtype=np.uint64, count=n))
        if 0 < n < k:
            parts[-1] = np.concatenate([parts[-1], np.full(k - n, n, dtype=np.uint64)])
            counts[i] = k
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    ends = np.cumsum(counts)
    if len(flat) < k:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        made, factor = np.zeros(len(flat) - k + 1, dtype=np.uint64), _ODD
        for j in range(k):
            made += mix(flat[j : j + len(made)] + np.uint64(j)) * factor
            factor = factor * _ODD
        made = mix(made)
    inside = np.ones(len(made), dtype=bool)
    for j in range(1, k):  # shingles that begin in the last k - 1 words of a text reach into the next
        at = ends - j
        inside[at[(at >= 0) & (at < len(made)) & (counts >= j)]] = False
    return made[inside], np.concatenate([[0], np.cumsum(np.maximum(counts - (k - 1), 0))])


def filter_positions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a 64-bit key in a key filter."""
    mask = np.uint64((1 << FILTER_BITS) - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(40)) & mask).astype(np.int64)


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = filter_positions(keys)
    return ((bits[one >> 3] >> (one & 7)) & (bits[two >> 3] >> (two & 7)) & 1).astype(bool)


def key_filter(keys: DataFrame, column: str):
    """Broadcast of a Bloom filter over a bigint column of well-mixed hashes.

    Its size is fixed (2 MB). With very many keys it merely lets more rows pass: what
    passes must still be joined to the keys, so results never depend on it.
    """
    mask, key = (1 << FILTER_BITS) - 1, F.col(column)
    words = (
        keys.select(F.explode(F.array(key.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 40).bitwiseAND(F.lit(mask)))).alias("at"))
        .groupBy(F.shiftright("at", 5).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("bits"))
    )
    bits = np.zeros(1 << (FILTER_BITS - 5), dtype=np.uint32)
    for batch in words.toArrow().to_batches():  # at most 2**19 rows
        bits[batch.column("word").to_numpy()] = batch.column("bits").to_numpy(zero_copy_only=False).astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names, or the one that the session already uses; only where none is set (tests) a new temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there: lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them from there: like ``cut``, smaller on disk, and a reader takes only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body and its inner functions use it."""
    return F.transform(F.array(value), body)[0]


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def crc_mod(id_col: Column | str, modulus: int) -> Column:
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col) % modulus


#: A key with more than one row in this many is hot.
HOT_SHARE = 1_000


def hot_keys(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The keys that hold more than 1 / HOT_SHARE of ``total`` rows: HOT_SHARE of them at most, so they may be broadcast."""
    return cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > max(total // HOT_SHARE, HOT_SHARE // 10)).select(*keys))


def join_split(rows: DataFrame, lookup: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to lookup, which has one row for a key, as an inner or left join.

    Rows of a hot key stay where they are and meet the lookup's at most HOT_SHARE rows by broadcast; all
    others are shuffled, so no task gets more than a small share of the rows.
    """
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    cold = marked.where("_hot is null").drop("_hot").join(lookup, keys, how)
    return cold.unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(lookup.join(F.broadcast(hot), keys, "left_semi")), keys, how))


def join_salted(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, total: int) -> DataFrame:
    """rows joined to lookup, which may have many rows for a key, as an inner join.

    Rows of a hot key are dealt by the column ``spread`` over as many salts as there are shuffle partitions, and the lookup's rows
    of those at most HOT_SHARE keys are repeated for each; all other keys are shuffled as they are.
    """
    hot = F.broadcast(hot_keys(rows, keys, total).withColumn("_hot", F.lit(True)))
    salts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) of bigints: rows (node, component), the smallest node of each.

    Rounds of alternating star contraction until nothing changes; each round's edges go to the checkpoint folder. The edges of
    a hub are not shuffled by the hub, and minima are pre-aggregated before each shuffle.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        upward = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = cut(join_split(upward, low, ["u"], hot_keys(upward, ["u"], before[0])).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct())
        down = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        downward = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = join_split(downward, down, ["u"], hot_keys(downward, ["u"], before[0]))
        edges = cut(small.select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b")).where("a <> b").unionByName(down.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    stars = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
