"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Documents are encoded once, where they are read; a chunk of rows sends one row for each length it has, so the
shuffle grows with the number of lengths, not of documents. The histogram goes to the checkpoint folder before its sums
are taken. Suffix sums run in three levels (groups of blocks, blocks of lengths, within a block): each task of a window has
BLOCK rows a key at most, and only the groups, one for BLOCK * BLOCK lengths, are ordered together.

Defined cases: a null or empty text has length 0; an empty table gives an empty histogram; repeated rows count again.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 64


def length_histogram(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """(length, n_docs): documents by the number of ids of their whole text."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def work(ids: list, texts: list[str]) -> dict:
        counts = Counter(tokens.lengths(texts, vocabulary))
        return {"length": list(counts), "n_docs": list(counts.values())}

    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return common.map_texts(rows, work, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length L of the histogram, taken as a context limit:

    docs_at_least and tokens_at_least: of documents of L ids or more; truncated_tokens: the total if each document is cut
    to L ids; share_at_most: the share of documents of at most L ids, so the q-quantile is the least L with share >= q.
    Between two lengths of the histogram the truncated total is linear: truncated_tokens of the lower one plus
    (limit - L) * documents longer than L.
    """
    rows = common.cut(histogram).select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).withColumn("group", F.floor(F.col("block") / BLOCK))
    groups = blocks.groupBy("group").agg(F.sum("d").alias("group_d"), F.sum("t").alias("group_t"))
    later = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = Window.orderBy(F.desc("group"))
    everything = last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select("group", later(last, "group_d").alias("docs_later"), later(last, "group_t").alias("tokens_later"), F.sum("group_d").over(everything).alias("all_docs"), F.sum("group_t").over(everything).alias("all_tokens"))
    behind = Window.partitionBy("group").orderBy(F.desc("block"))
    blocks = blocks.join(groups, "group").select("block", (later(behind, "d") + F.col("docs_later")).alias("docs_after"), (later(behind, "t") + F.col("tokens_later")).alias("tokens_after"), "all_docs", "all_tokens")
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(blocks, "block").withColumns(
        {"docs_at_least": F.sum("n_docs").over(within) + F.col("docs_after"), "tokens_at_least": F.sum("tokens").over(within) + F.col("tokens_after")}
    )
    return joined.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("share_at_most"),
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """One row (limit, tokens): the total of ids if each document is cut to ``limit`` ids."""
    below = limits.where(F.col("length") <= limit).agg(F.max_by(F.struct("length", "truncated_tokens", "docs_at_least", "n_docs"), "length").alias("x"))
    longest = limits.agg(F.max("docs_at_least").alias("docs"))
    longer = F.col("x.docs_at_least") - F.col("x.n_docs")
    return below.crossJoin(longest).select(  # two rows of one row each
        F.lit(limit).alias("limit"),
        F.when(F.col("x").isNull(), limit * F.coalesce("docs", F.lit(0))).otherwise(F.col("x.truncated_tokens") + (limit - F.col("x.length")) * longer).alias("tokens"),
    )


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """One row (q, length): the least length that at least the share q of documents does not exceed."""
    return limits.where(F.col("share_at_most") >= q - 1e-12).agg(F.lit(q).alias("q"), F.min("length").alias("length"))
