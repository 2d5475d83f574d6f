"""PII: fixed rules, then bootstrapped contextual extraction, in DataFrame functions only.

Rules find emails, addresses, cards and phone numbers. They seed the extraction: every token with a digit or an @ is an
instance; its lexical patterns are the word and the two words before it, the word and the two words after it, and the pair of words
around it. Spark scores the pattern-instance graph in rounds. A pattern's confidence is the number of its different instances
that are seeds, or accepted with their confidence, over the number of all its instances (plus a constant, so rare
patterns stay low). An instance's confidence is 1 for a seed, else that of its best pattern, and it is accepted once that reaches
the limit: patterns without support don't count against it, and what no round accepted counts against its patterns.
Accepted instances that no rule knows are spans of kind ``context`` where they stand in a confident pattern.

One pass over the texts makes rule spans and instances; the graph is built from those. Positions are sums of lengths of the pieces between matches, taken in chunks,
so work grows with the text's length. They are code points, as in the text.

Defined cases: null and empty texts have no spans; without seeds nothing is discovered; identifiers without a digit or an @ (names) are
beyond this method. Rows are told apart by a key of id and text, so null and repeated doc_ids are found one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "context")
#: A match begins where a run of its characters begins, or where the match before ended: what leftmost matching finds, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: One or two words at the end of a text, and at its beginning.
BEFORE, AFTER = r"((?:(?<!\S)\S++\s++)?+(?<!\S)\S++)\s*+$", r"^\s*+(\S++(?:\s++\S++)?+)"
CHUNK = 256
INSTANCE = rf"{PHONE}|[0-9](?:[\x20-]?[0-9]){{12,18}}+|(?<!\S)[^\s0-9@]*+[0-9@]\S*"


def sums_before(lengths: Column) -> Column:
    """For each of an array's numbers (one at least) the sum of those before it; arrays grow within a chunk only."""

    def prefix(xs: Column, value) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["at"] + value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    chunks = common.let(lengths, lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_), F.lit(CHUNK)), lambda i: prefix(F.slice(all_, i, F.lit(CHUNK)), lambda x: x)))
    shifted = lambda c, base: F.transform(c["out"], lambda x: x + base)
    return common.let(chunks, lambda cs: F.flatten(F.zip_with(cs, prefix(cs, lambda c: c["at"])["out"], shifted)))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of all matches."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(h), F.lit(0)).alias("size"), h.alias("hit")))  # gaps have one more: its hit is null
    made = lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["hit"].alias("hit"))
    placed = common.let(pairs, lambda ps: F.zip_with(ps, sums_before(F.transform(ps, lambda p: p["gap"] + p["size"])), made))
    return F.filter(placed, lambda s: s["hit"].isNotNull())


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    number = F.reverse(digits(hit))
    at = F.sequence(F.lit(1), F.length(number))

    def value(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(at, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def low_parts(hit: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def rules(text: Column) -> dict[str, Column]:
    """array<struct<start, end>> of each kind; expensive matching only for texts that hold what a match needs."""

    def bare(spans: Column, good) -> Column:
        kept = F.filter(spans, lambda s: good(s["hit"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    count = lambda hit: F.length(digits(hit))
    return {
        "email": F.when(F.contains(text, F.lit("@")), bare(spans_of(text, EMAIL), lambda h: F.lit(True))).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), bare(spans_of(text, IP), low_parts)).otherwise(none),
        "card": F.when(text.rlike(CARD), bare(spans_of(text, CARD), luhn)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), bare(spans_of(text, PHONE), lambda h: (count(h) >= 9) & (count(h) <= 15))).otherwise(none),
    }


def words_around(text: Column) -> Column:
    """array<struct<before, after>>: up to two lower-case words on either side of each instance."""
    gaps = F.split(text, INSTANCE, -1)
    words = lambda gap, pattern: F.split(F.lower(F.regexp_extract(gap, pattern, 1)), r"\s+")
    ends = F.transform(gaps, lambda g: F.struct(words(g, BEFORE).alias("before"), words(g, AFTER).alias("after")))
    pair = lambda a, b: F.struct(a["before"].alias("before"), b["after"].alias("after"))
    return common.let(ends, lambda es: F.zip_with(F.slice(es, F.lit(1), F.size(es) - 1), F.slice(es, F.lit(2), F.size(es)), pair))


def patterns_of(around: Column) -> Column:
    """Hashes of the patterns of an instance; none of an absent word."""
    one, two = around["before"], around["after"]
    left, right = F.element_at(one, -1), two[0]
    made = F.array(
        F.when(left != "", F.xxhash64(F.lit("L"), left)), F.when(F.size(one) > 1, F.xxhash64(F.lit("LL"), one[0], left)),
        F.when(right != "", F.xxhash64(F.lit("R"), right)), F.when(F.size(two) > 1, F.xxhash64(F.lit("RR"), right, two[1])),
        F.when((left != "") & (right != ""), F.xxhash64(F.lit("B"), left, right)),
    )
    return F.array_compact(made)


def with_spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, row_key, text) with an array of spans for each rule kind and of instances (start, end, instance, patterns, seed); the text goes."""
    found = docs.select("doc_id", "row_key", "text", *[c.alias(k) for k, c in rules(F.col("text")).items()])

    def instance(s: Column, around: Column, base: Column) -> Column:
        head, tail = F.length(F.regexp_extract(s["hit"], r"^[\"'(\[{<]*+", 0)), F.length(F.regexp_extract(s["hit"], r"[\"')\]}>.,;:!?]++$", 0))
        start, end = s["start"] + head, s["end"] - tail
        seed = F.exists(base, lambda b: (b["start"] < end) & (start < b["end"]))
        return F.struct(start.alias("start"), end.alias("end"), F.xxhash64(s["hit"]).alias("instance"), patterns_of(around).alias("patterns"), seed.alias("seed"))

    seen = common.let(F.concat(*KINDS[:4]), lambda base: F.zip_with(spans_of(F.col("text"), INSTANCE), words_around(F.col("text")), lambda s, around: instance(s, around, base)))
    none = F.array().cast("array<struct<start:int,end:int,instance:bigint,patterns:array<bigint>,seed:boolean>>")
    some = F.when(F.col("text").rlike("[0-9@]"), F.filter(seen, lambda x: x["end"] > x["start"])).otherwise(none)
    return found.select("doc_id", "row_key", *KINDS[:4], some.alias("instances"))


def confident(edges: DataFrame, rounds: int, prior: float, least: float) -> tuple[DataFrame, DataFrame]:
    """(pattern), (instance): confident patterns and accepted instances after some rounds over the edges (pattern, instance, seed)."""
    n, unseen = edges.count(), edges.where("not seed")
    by_pattern, by_instance = common.hot_keys(unseen, ["pattern"], n), common.hot_keys(edges, ["instance"], n)
    scored, found = edges.withColumn("c", F.col("seed").cast("double")), None
    score = lambda: scored.groupBy("pattern").agg((F.sum("c") / (F.count("*") + prior)).alias("p")).where(F.col("p") >= least)
    for _ in range(rounds):
        found = common.cut(common.join_split(unseen, score(), ["pattern"], by_pattern).groupBy("instance").agg(F.max("p").alias("c")))
        scored = common.join_split(edges, found, ["instance"], by_instance, "left").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("c"))
    return score().select("pattern"), found.select("instance")


def find_pii(docs: DataFrame, rounds: int = 3, prior: float = 2.0, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and an array of spans (start, end), in code points, for each of KINDS."""
    rows = common.cut(with_spans(common.keyed_rows(docs, id_col, text_col)))
    seen = rows.select("row_key", F.explode("instances").alias("i")).select("row_key", "i.*")
    edges = common.cut(seen.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    patterns, found = confident(edges, rounds, prior, least)
    n_edges = edges.count()
    good = common.join_split(edges.select("pattern", "instance"), found, ["instance"], common.hot_keys(edges, ["instance"], n_edges))
    good = common.cut(common.join_split(good, patterns, ["pattern"], common.hot_keys(edges, ["pattern"], n_edges)))
    unseen = seen.where("not seed").select("row_key", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    placed = common.join_split(unseen, good, ["instance", "pattern"], common.hot_keys(unseen, ["instance", "pattern"], unseen.count()))
    spans = placed.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("context"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.drop("instances").join(spans, "row_key", "left").select("doc_id", *KINDS[:4], F.coalesce("context", none).alias("context"))


def named_as(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def digest(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_context, n_spans, base_sha256, spans); n_spans counts all."""
    named = {k: F.transform(k, named_as(k)) for k in KINDS}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.array_join(F.concat(*[named[k] for k in KINDS[:4]]), ",")
    total = F.size(F.concat(*KINDS)).cast("long").alias("n_spans")
    return spans.select("doc_id", *counts, total, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(*named.values()), ",").alias("spans"))
