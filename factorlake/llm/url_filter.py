"""URL filters: rules first, then trust and distrust propagated over the links between hosts; DataFrame functions only.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest fitting rule decides.
Urls that no rule fits get the verdict of their host. Hosts most of whose pages a rule allows are trusted seeds, those most of
whose pages a rule blocks are blocked seeds. Trust is personalised PageRank along links from the trusted seeds; distrust is
the same along reversed links from the blocked seeds (who links to bad hosts is suspect). A host whose distrust
exceeds ``ratio`` times its trust is blocked, any other allowed.

Links are absolute ``href`` values, counted once for each page and pair of hosts and pre-aggregated; links within a host don't count.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; null html has no links;
without links or seeds ranks stay with the seeds; repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The rules of the registered query: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null."""
    made = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        made = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(made)
    return made


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of host src that link to host dst."""
    found = pages.where("html is not null and host <> ''").select("host", F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda h: F.translate(h, UPPER, LOWER))).alias("to"))
    return found.select(F.col("host").alias("src"), F.explode("to").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def seeds(judged: DataFrame) -> DataFrame:
    """(kind, host, seed): trusted and blocked seeds; the seeds of a kind sum to 1."""
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    hosts = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    either = hosts.select("host", F.when(F.col("trust") > 0.5, "trust").when(F.col("distrust") > 0.5, "distrust").alias("kind")).where("kind is not null")
    totals = either.groupBy("kind").agg(F.count("*").alias("all"))
    return either.join(totals, "kind").select("kind", "host", (1.0 / F.col("all")).alias("seed"))


def propagate(links: DataFrame, start: DataFrame, damping: float, rounds: int) -> DataFrame:
    """(kind, host, rank) after some rounds of personalised PageRank; both kinds go in one job, distrust on reversed links."""
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    out = both.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    steps = common.cut(both.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w")))
    start = common.cut(start)
    rank = start.select("kind", "host", F.col("seed").alias("rank"))
    n_steps = steps.count()
    if not n_steps:
        return rank
    hubs = common.hot_keys(steps, ["kind", "a"], n_steps)
    for done in range(1, rounds + 1):
        moved = common.join_split(steps, rank.withColumnRenamed("host", "a"), ["kind", "a"], hubs).select("kind", F.col("b").alias("host"), (damping * F.col("rank") * F.col("w")).alias("part"))
        back = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("part"))
        rank = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("part").alias("rank"))
        if done % 4 == 0 or done == rounds:
            rank = common.cut(rank)
    return rank


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, damping: float = 0.85, rounds: int = 12, ratio: float = 1.0, id_col: str = "page_id") -> DataFrame:
    """One row for each row of pages: (page_id, host, path, rule, verdict, by_method)."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "_r.rule", "_r.verdict")
    rank = propagate(host_links(pages.select(host_of(F.col("url")).alias("host"), "html")), seeds(judged), damping, rounds)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    bad = rank.groupBy("host").agg(of("trust").alias("t"), of("distrust").alias("d")).where(F.col("d") > ratio * F.col("t")).select("host", F.lit("block").alias("_method"))
    open_ = judged.where("rule is null")
    open_ = common.join_split(open_, bad, ["host"], common.hot_keys(open_, ["host"], open_.count()), "left")
    by_method = open_.select("page_id", "host", "path", "rule", F.coalesce("_method", F.lit("allow")).alias("verdict"), F.lit(True).alias("by_method"))
    return judged.where("rule is not null").withColumn("by_method", F.lit(False)).unionByName(by_method)
