"""URL filters by link-graph propagation, in DataFrame operations alone.

Rules (host, path, verdict) judge the urls that they fit. Hosts are then judged through the links between them: trust is a
personalised PageRank that starts at hosts with pages that rules allow and follows links; distrust starts at hosts with
pages that rules block and follows links backwards, to those who link there. A host whose distrust exceeds `ratio` times
its trust is blocked, and a page without a fitting rule takes its host's verdict.

Links are pre-aggregated to weighted host edges, so a host with very many links costs as many rows as it has neighbour
hosts. Mass of hosts without outgoing links ends there. Rounds are cut at the shared folder.

Defined cases: a null url, or one without "://", has empty host and path and fits no rule; all such pages share the
host ""; a null html has no links; repeated pages count each time; hosts that neither trust nor distrust reaches are
allowed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import cut

#: The rules of the registered query, as (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path together, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(source, target, n): links from a host's pages to another host, from pages (host, html)."""
    hosts = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.select(F.col("host").alias("source"), F.explode(hosts).alias("target"))
    links = links.withColumn("target", F.translate("target", UPPER, LOWER))
    return links.where("source <> target and target <> '' and source <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, rounds: int = 60, damping: float = 0.85, cut_every: int = 4, tolerance: float = 1e-4) -> DataFrame:
    """hosts: (host, allowed, blocked) page counts. Adds trust and distrust, each summing to 1 at most.

    Rounds end when `cut_every` of them have moved no more than `tolerance` of each kind's mass, or after `rounds`.
    """
    kinds = [("trust", "allowed", "source", "target"), ("distrust", "blocked", "target", "source")]
    totals = hosts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()  # two numbers
    known = hosts.unionByName(edges.select(F.explode(F.array("source", "target")).alias("host")).distinct().select("host", F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked")))
    known = known.groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    seeds = flows = None
    for kind, count, start, end in kinds:
        s = known.select("host", F.lit(kind).alias("kind"), (F.col(count) / F.lit(float(max(1, totals[count] or 0)))).alias("seed"))
        out = edges.groupBy(start).agg(F.sum("n").alias("all"))
        f = edges.join(out, start).select(F.col(start).alias("host"), F.col(end).alias("to"), F.lit(kind).alias("kind"), (F.col("n") / F.col("all")).alias("w"))
        seeds, flows = (s, f) if seeds is None else (seeds.unionByName(s), flows.unionByName(f))
    seeds, flows = cut(seeds), cut(flows)
    ranks, settled = seeds.withColumn("rank", F.col("seed")), None
    if flows.limit(1).count():
        for i in range(rounds):
            moved = flows.join(ranks, ["host", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("rank") * F.col("w")).alias("came"))
            ranks = seeds.join(moved, ["host", "kind"], "left").select("host", "kind", "seed", (F.col("seed") * (1 - damping) + F.coalesce("came", F.lit(0.0)) * damping).alias("rank"))
            if i % cut_every == cut_every - 1:
                before, ranks = settled, cut(ranks)
                settled = ranks.select("host", "kind", F.col("rank").alias("old"))
                if before is not None and tolerance:
                    moved_mass = ranks.join(before, ["host", "kind"]).groupBy("kind").agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("m")).agg(F.max("m")).first()[0]
                    if moved_mass is None or moved_mass <= tolerance:
                        break
    return ranks.groupBy("host").agg(*[F.round(F.sum(F.when(F.col("kind") == k, F.col("rank"))), 12).alias(k) for k in ("trust", "distrust")])


def judge_urls(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, ratio: float = 1.0, rounds: int = 60) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, host_trust, host_distrust."""
    named = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    narrow = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    hosts = narrow.groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    ranks = cut(propagate(cut(hosts), cut(host_edges(named)), rounds))
    by_host = ranks.select("host", "trust", "distrust", F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow").alias("by_host"))
    return narrow.join(by_host, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("host_trust"), F.coalesce("distrust", F.lit(0.0)).alias("host_distrust")
    )
