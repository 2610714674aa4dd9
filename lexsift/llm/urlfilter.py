"""URL verdicts from rules and, where no rule fits, from link-graph propagation over hosts.

Trust flows from hosts with allowed pages along links; distrust flows from hosts with blocked
pages against them (who links to a bad host is suspect).  Both are personalised PageRanks, and a page that a
rule allows starts as much trust as a blocked one starts distrust, so that the two compare.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, materialise

#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rounds end once no rank changes by more than its share TOLERANCE, so also not while new hosts are
#: reached; ranks that have not settled after ROUNDS are an error.
DAMPING, ROUNDS, RATIO, TOLERANCE = 0.85, 1000, 1.0, 1e-6
#: By what share distrust has to exceed trust: rounding and unsettled ranks must not break ties.
MARGIN = 1e-4


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The (rule, verdict) of the longest rule that fits host, subdomains and path; else nulls."""

    def fits(h: str, p: str) -> Column:
        return ((host == h) | host.endswith(f".{h}")) & path.startswith(p)

    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: reduce(lambda chain, r: chain.when(fits(r[1], r[2]), F.lit(value(r))), ordered, F) if ordered else F.lit(None).cast("string")
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind of walk.

    ``edges(kind, src, dst, w)`` and ``seeds(kind, host, s)``.  A walk restarts at a seed, in proportion to s, with
    probability 1 - damping and wherever its host has no edge.  Ranks of a kind add up to the sum of its s.
    Walks go on until no rank changes by more than ``tolerance`` times itself; a host that is
    reached for the first time changes by all of its rank.
    """
    start = cut(seeds.groupBy("kind", "host").agg(F.sum("s").alias("s")))
    mass = {r[0]: r[1] for r in start.groupBy("kind").agg(F.sum("s")).collect()}  # a number for each kind of walk
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    step = materialise(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("total")).alias("p")), "steps")
    rank, zero = start.withColumnRenamed("s", "rank"), F.lit(0.0)
    for _ in range(rounds):
        moved = rank.join(step, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p") * damping).alias("x"))
        moved = cut(moved.groupBy("kind", "host").agg(F.sum("x").alias("x")))
        kept = {r[0]: r[1] for r in moved.groupBy("kind").agg(F.sum("x")).collect()}  # a number for each kind
        back = F.lit(1.0)
        for k in sorted(kept):
            back = F.when(F.col("kind") == k, F.lit(1.0 - kept[k] / mass[k])).otherwise(back)
        returned = start.select("kind", "host", (F.col("s") * back).alias("x"))
        both = moved.withColumn("old", zero).union(returned.withColumn("old", zero)).union(rank.select("kind", "host", zero.alias("x"), F.col("rank").alias("old")))
        both = cut(both.groupBy("kind", "host").agg(F.sum("x").alias("rank"), F.sum("old").alias("old")))
        rank = both.select("kind", "host", "rank")
        change = both.agg(F.max(F.try_divide(F.abs(F.col("rank") - F.col("old")), F.greatest("rank", "old")))).first()[0]
        if not (change or 0.0) > tolerance:
            return rank
    raise RuntimeError("ranks did not settle")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, ratio: float = RATIO) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages(page_id, url, html)``.

    Seeds are weighed by their pages that a rule allows or blocks; trust and distrust of all hosts add up to 1.
    Where no rule fits, a host is blocked if its distrust exceeds ``ratio`` times its trust (by more than the share MARGIN), else
    allowed; hosts that neither walk reaches, and urls without a host, are allowed.  Null urls
    and html count as empty.  Repeated rows are judged alike and their links count again.
    Links within a host are no edges.  Extra columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).select("page_id", host.alias("host"), path.alias("path"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("links"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = materialise(pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.coalesce("links", F.array().cast("array<string>")).alias("links")), "pages")
    linked = judged.filter("host <> ''").select("host", F.explode("links").alias("dst")).select("host", F.translate("dst", UPPER, LOWER).alias("dst")).filter("host <> dst")
    counted = linked.groupBy("host", "dst").agg(F.count("*").cast("double").alias("w"))
    edges = cut(counted.select(F.lit("trust").alias("kind"), F.col("host").alias("src"), "dst", "w").union(counted.select(F.lit("distrust"), F.col("dst"), F.col("host"), "w")))
    seeds = judged.filter("host <> '' and ruled is not null").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("kind"), "host").count()
    seeds = cut(seeds)
    number = seeds.agg(F.sum("count")).first()[0] or 1
    rank = propagate(edges, seeds.select("kind", "host", (F.col("count") / number).alias("s")), damping, rounds)
    scores = rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("distrust"))
    zero = F.lit(0.0)
    out = judged.join(scores, "host", "left").withColumn("trust", F.coalesce("trust", zero)).withColumn("distrust", F.coalesce("distrust", zero))
    method = F.when(F.col("distrust") > ratio * (1 + MARGIN) * F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
