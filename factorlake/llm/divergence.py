"""Source divergence audit: how far each source's use of terms lies from other sources' and from its language's.

Each language keeps the terms that at least ``LEAST_DOCS`` of its documents hold. A group (lang, source), and a language, gives a
kept term p = 1 + floor(SCALE * (count + 1) / (N + V)); p against q diverges by f = floor((p - q)^2 / q), all in integers.

The sum of f over all kept terms of two sources needs no product of terms and sources. Where neither has a term f is one number, so
    value(s, o) = V * f(none, none) + corrections of terms that s has + of terms that o has + of terms that both have.
Terms of one side are grouped by their count. Terms of both come from a frequent-pattern tree: a term is a row of its nonzero counts
in the order of the sources' size, equal rows are one row with a multiplicity, and sorted rows that begin alike share their nodes.
A pair's correction is computed once for each node and ancestor and multiplied by the node's multiplicity. Corrections of disjoint
rows add up, so Spark deals sorted rows by range and every task builds the tree of its own rows, level by level, in arrays.

Defined cases: null text, lang and source are empty; a group without terms has count 0 everywhere; a language without kept terms has
value 0 for every pair; a source alone in its language has no pairs; equal values rank by the item's bytes; repeated rows count
again; an empty table gives no rows; other columns aren't read. Counters of a task hold at most ``ENTRIES`` terms and one text's.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1_000_000_000
LEAST_DOCS = 3
#: Ranks of part ``term`` that are reported.
TOP = 200
#: Terms in a task's counters before they are sent on; a term longer than 32 bytes counts as several.
ENTRIES = 1_000_000
#: Cells (rows by depth) of the tree that a task builds at once.
CELLS = 2_000_000
#: Terms are runs of ASCII letters and of everything beyond ASCII; only A-Z are lower-cased.
FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and documents; a row with an empty term marks each group that occurs."""
    names = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in names.items()])

    def sent(total: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in total.items():
            terms, of = [b"", *counts], held[lang, source]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *counts.values()], [0, *(of[t] for t in counts)]]
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                terms = text.as_py().translate(FOLD).split()
                own = set(terms)
                total[lang, source].update(terms)
                held[lang, source].update(own)
                size += len(own) + sum(map(len, own)) // 32
                if size >= ENTRIES:
                    yield from sent(total, held)
                    total, held, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from sent(total, held)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)) without overflow; 1 where there is nothing to divide by."""
    return F.expr(f"1L + coalesce((cast({SCALE} as decimal(18, 0)) * cast({n} + 1 as decimal(19, 0))) div nullif(cast({total} + {terms} as decimal(19, 0)), 0), 0L)")


def f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def beyond(p, q):
    return (p - q) * (p - q) // q


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.add.reduceat(values, starts) if len(starts) else values


def tree_corrections(lengths: np.ndarray, rank: np.ndarray, n: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranks of s, ranks of o, sums of the corrections of terms that both have) of rows sorted by their (rank, n) items.

    A node at depth d is a stretch of rows with equal first d + 1 items; its multiplicity is the sum of theirs.
    """
    rows, depth = len(lengths), int(lengths.max(initial=0))
    at = (np.repeat(np.arange(rows), lengths), np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    table = np.full((4, rows, depth), -1, dtype=np.int64)
    for level, values in zip(table, (rank, n, p, p0), strict=True):
        level[at] = values
    alike = (table[0, 1:] == table[0, :-1]) & (table[1, 1:] == table[1, :-1]) & (table[0, 1:] >= 0)
    common_items = np.concatenate([[0], np.cumprod(alike, axis=1).sum(axis=1)]) if depth else np.zeros(rows, dtype=np.int64)
    keys, values, wide = [], [], np.int64(int(rank.max(initial=0)) + 1)
    for d in range(1, depth):
        starts = np.flatnonzero(common_items <= d)
        multiplicity = np.add.reduceat(times, starts)
        starts, multiplicity = starts[lengths[starts] > d], multiplicity[lengths[starts] > d]
        s, _, x, x0 = table[:, starts, d][:, :, None]
        o, _, y, y0 = table[:, starts, :d]
        for one, two, a, a0, b, b0 in ((s, o, x, x0, y, y0), (o, s, y, y0, x, x0)):
            made = (beyond(a, b) - beyond(a, b0) - beyond(a0, b) + beyond(a0, b0)) * multiplicity[:, None]
            k, v = summed((one * wide + two).ravel(), made.ravel())
            keys.append(k)
            values.append(v)
    keys, values = summed(np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    return keys // wide, keys % wide, values


def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, path, times) in sorted order to (lang, s, o, value)."""
    for batch in batches:
        langs, times = np.array(batch.column("lang").to_pylist(), dtype=object), batch.column("times").to_numpy()
        paths = batch.column("path")
        ends = paths.offsets.to_numpy().astype(np.int64)
        ends, items = ends - ends[0], paths.flatten()
        items = [items.field(k).to_numpy().astype(np.int64) for k in range(4)]
        lo = 0
        while lo < len(langs):
            hi, deepest = lo, 0
            while hi < len(langs) and langs[hi] == langs[lo]:
                deepest = max(deepest, int(ends[hi + 1] - ends[hi]))
                if hi > lo and deepest * (hi + 1 - lo) > CELLS:
                    break
                hi += 1
            s, o, value = tree_corrections(np.diff(ends[lo : hi + 1]), *[x[ends[lo] : ends[hi]] for x in items], times[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array([langs[lo]] * len(s), type=pa.string()), pa.array(s), pa.array(o), pa.array(value)], names=["lang", "s", "o", "value"])
            lo = hi


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` against every other source of the language, part ``term`` the terms used above the language's share."""
    counted = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("uses"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    stored = common.store(by_term.where((F.col("term") == "") | (F.col("docs") >= least_docs)).drop("docs"))  # one exchange: both groupings are by the columns dealt by

    kept = stored.where("term <> ''")
    uses = kept.select("lang", "term", "total", F.inline("uses")).where("n > 0")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    sizes = uses.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    groups = stored.where("term = ''").select("lang", F.inline("uses")).drop("n").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").fillna(0, ["terms", "lang_n", "own_n"])
    by_size = Window.partitionBy("lang").orderBy(F.desc("own_n"), "source")
    groups = common.cut(groups.select("*", share("0", "own_n", "terms").alias("p0"), F.row_number().over(by_size).cast("long").alias("rank_in")))

    items = uses.join(groups, ["lang", "source"]).withColumns({"p": share("n", "own_n", "terms"), "q": share("total", "lang_n", "terms")})
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = items.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))
    of_terms = of_terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("o0"))
    base = groups.join(others, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"terms * {f('p0', 'o0')}").alias("value"))
    single = items.groupBy("lang", "source", "n").agg(F.count("*").alias("times"), F.first("p").alias("p"), F.first("p0").alias("p0")).join(others, "lang").where("source <> item")
    forth = single.select("lang", "source", "item", F.expr(f"times * ({f('p', 'o0')} - {f('p0', 'o0')})").alias("value"))
    back = single.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"times * ({f('o0', 'p')} - {f('o0', 'p0')})").alias("value"))

    paths = items.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("rank_in", "n", "p", "p0"))).alias("path")).where("size(path) > 1")
    rows = paths.groupBy("lang", "path").agg(F.count("*").alias("times")).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    shared = rows.mapInArrow(tree, "lang string, s long, o long, value long").groupBy("lang", "s", "o").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "source", "rank_in")
    shared = shared.join(named.withColumnRenamed("rank_in", "s"), ["lang", "s"]).join(named.select("lang", F.col("source").alias("item"), F.col("rank_in").alias("o")), ["lang", "o"]).select("lang", "source", "item", "value")

    of_pairs = base.unionByName(forth).unionByName(back).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    of_pairs = of_pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return of_pairs.unionByName(of_terms)
