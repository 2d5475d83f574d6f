"""Document fingerprints from closed syncmers, in DataFrame functions only.

A document is a sequence of units, mostly words. Of its k-mers (k consecutive units) those are anchors whose minimal inner s-mer, by hash,
lies at an edge. Whether a k-mer is an anchor depends on its own units alone, so a passage has the same anchors wherever
it stands. A fingerprint is the whole sequence of anchors, each with the distance to the next: nothing is sampled or cut off.

Likeness is the Jaccard index of the anchor sets of two fingerprints. Positional matching asks for more: a link is an anchor, the next one and
their distance, so two documents share a link only where both anchors stand equally far apart; ``aligned`` is the Jaccard
index of the links, and needs no common origin. Both read the fingerprints only.

Units are runs of non-blank characters in lower case; in a run of more than 16 characters (scripts without blanks, encoded data) each
character is a unit, so no unit depends on where a run began. No row is exploded for a fingerprint and nothing shuffled.

Defined cases: a null or empty text has an empty fingerprint; two empty ones have likeness 1, one with another 0; a text in which no k-mer
is an anchor, or of fewer than k units, has one anchor, all its units. In ``edited_neighbours`` equal doc_ids are ordered by a hash
of id and text, null ids come last, and the only document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K, S = 5, 2
#: Ranges of documents for one shuffle partition, and steps of a search in their bounds (at most 2**STEPS ranges).
RANGES, STEPS = 16, 24


def units(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"(?:\G(?!^)|(?<!\S)(?=\S{17}))(\S)", "$1 ")
    return F.filter(F.split(spaced, r"\s+"), lambda w: w != "")


def anchors(text: Column) -> Column:
    """array<struct<position, anchor>>: hashes of the k-mers that are anchors, with the place of their first unit."""

    def of(h: Column) -> Column:
        smers = F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))

        def chosen(m: Column) -> Column:  # 4 s-mers in a k-mer
            edge = lambda i: F.least(m[i], m[i + 3]) <= F.least(m[i + 1], m[i + 2])
            made = F.transform(F.sequence(F.lit(0), F.size(m) - 4), lambda i: F.when(edge(i), F.struct(i.alias("position"), F.hash(m[i], m[i + 2], m[i + 3]).alias("anchor"))))
            return F.array_compact(made)

        all_units = F.hash(F.concat_ws(" ", F.transform(h, lambda x: x.cast("string"))))
        one = F.array(F.struct(F.lit(0).alias("position"), all_units.alias("anchor")))
        none = F.array().cast("array<struct<position:int,anchor:int>>")
        many = F.when(F.size(h) >= K, common.let(smers, chosen)).otherwise(none)
        return F.when(F.size(h) == 0, none).otherwise(common.let(many, lambda x: F.when(F.size(x) > 0, x).otherwise(one)))

    return common.let(F.transform(units(text), lambda w: F.xxhash64(w)), of)


def anchor_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, anchor): one row for each anchor, for positional matching by joins."""
    return common.text_rows(docs, id_col, text_col).select("doc_id", F.inline(anchors(F.col("text"))))


def fingerprint(anchor: Column) -> Column:
    """array<struct<anchor, gap>>: gap is the distance to the next anchor, null for the last."""
    after = F.slice(anchor, F.lit(2), F.greatest(F.size(anchor), F.lit(1)))
    return F.zip_with(anchor, after, lambda a, b: F.struct(a["anchor"].alias("anchor"), (b["position"] - a["position"]).alias("gap")))


def links(print_: Column) -> Column:
    """Hashes of two anchors in a row and their distance; of the last anchor alone."""
    after = F.slice(print_, F.lit(2), F.greatest(F.size(print_), F.lit(1)))
    return F.zip_with(print_, after, lambda a, b: F.hash(a["anchor"], a["gap"], b["anchor"]))


def shown(print_: Column) -> Column:
    """Each anchor as 8 hexadecimal digits, and its distance to the next."""
    digits = lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.array_join(F.transform(print_, lambda e: F.concat(digits(e["anchor"]), F.coalesce(F.concat(F.lit("+"), e["gap"].cast("string")), F.lit("")))), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of numbers as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def likeness(a: Column, b: Column) -> Column:
    return jaccard(F.transform(a, lambda e: e["anchor"]), F.transform(b, lambda e: e["anchor"]))


def aligned(a: Column, b: Column) -> Column:
    return jaccard(links(a), links(b))


def place_of(bounds: Column, value: Column) -> Column:
    """The number of sorted bounds below a value, by binary search; -1 for null."""
    zero = F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.try_element_at(bounds, mid + 1) < value
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.when(value.isNull(), F.lit(-1)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step, lambda s: s["lo"]))


def with_next(rows: DataFrame, made: dict[str, Column], columns: list[str], parts: int) -> DataFrame:
    """rows(doc_id, row_key, text) with columns ``made`` and with ``next_<c>`` of the next document, descending doc_id, then row_key; the first follows the last.

    Documents are cut into ranges by quantiles of doc_id; an id that holds many rows has a range of its own, cut again by row_key.
    The first row of each range goes along with the range before as a guest, so each range knows what follows it, texts are
    shuffled once, and no order is made over all rows in one task. Bounds and ranges number at most a few times ``parts``.
    """
    keys = common.cut(rows.select("doc_id", "row_key"))
    cuts = keys.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("b"))
    cuts = common.cut(cuts.select(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(F.coalesce("b", F.array().cast("array<long>")), lambda x: F.array(F.try_subtract(x, F.lit(1)), x)))))).alias("b")))
    place = place_of(F.col("_bounds"), F.col("doc_id"))
    ranged = lambda df: df.withColumn("_bounds", cuts.scalar()).withColumn("_range", place).drop("_bounds")
    sizes = ranged(keys).groupBy("_range").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    share = keys.agg(F.greatest(F.count("*") / parts, F.lit(1.0)).alias("n"))
    sizes = common.cut(sizes.withColumn("_share", share.scalar()).select("_range", F.when(F.col("least").isNull() | (F.col("least") == F.col("most")), F.ceil(F.col("n") / F.col("_share"))).otherwise(1).alias("_subs")))
    sub = F.floor((F.col("row_key") / F.lit(2.0**64) + 0.5) * F.col("_subs"))
    placed = lambda df: ranged(df).join(F.broadcast(sizes), "_range").withColumn("_sub", sub).drop("_subs")
    first = F.max_by(F.struct("doc_id", "row_key"), F.struct("doc_id", F.bitwise_not("row_key")))
    heads = placed(keys).groupBy("_range", "_sub").agg(first["row_key"].alias("row_key"))
    order = Window.orderBy(F.desc("_range"), "_sub")  # one row a range
    previous = lambda c: F.coalesce(F.lag(c).over(order), F.last(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias(c)
    guests = common.cut(heads.select("row_key", previous("_range"), previous("_sub")))
    visiting = rows.join(F.broadcast(guests), "row_key").dropDuplicates(["row_key", "_range", "_sub"]).withColumn("_guest", F.lit(True))
    together = placed(rows).withColumn("_guest", F.lit(False)).unionByName(visiting).repartition("_range", "_sub").withColumns(made)
    order = Window.partitionBy("_range", "_sub").orderBy("_guest", F.desc_nulls_last("doc_id"), "row_key")
    return together.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("_guest")).drop("_range", "_sub", "_guest")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last third comes from the next document."""
    rows = common.keyed_rows(docs, id_col, text_col)
    parts = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = with_next(rows, {"print": fingerprint_of("text")}, ["text", "print"], parts)
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_cut")).cast("int")), F.substring("next_text", F.lit(1), F.col("_cut"))))
    both = both.drop("text", "next_text").withColumn("edited_print", fingerprint_of("edited"))
    own, edited, following = F.col("print"), F.col("edited_print"), F.col("next_print")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(own).alias("fingerprint"), shown(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"), aligned(own, edited).alias("aligned_edited"), aligned(own, following).alias("aligned_next"),
    )


def fingerprint_of(text: str) -> Column:
    return common.let(anchors(F.col(text)), fingerprint)
