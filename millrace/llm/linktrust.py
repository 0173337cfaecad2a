"""Judging urls by rules and, where no rule fits, by trust and distrust that spread over links between hosts.

Rules name a host and the start of a path and hold for all subdomains. Hosts most of whose pages a rule allows are
trusted seeds, hosts most of whose pages a rule blocks are blocked seeds. Trust goes along links by personalised
PageRank from the trusted seeds. Distrust goes against links from the blocked seeds: who links to a blocked host is
distrusted, by the share of its links that go there. So a host's distrust is the personalised PageRank that the blocked
seeds have for a surfer who sets out from that host, a share from 0 to 1 whatever the number of hosts and seeds. It is held
against a bar of each host's own, which trust raises.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, MAX_HOT_KEYS, Scratch, lookup

#: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The tolerance is on distrust, and on trust as a multiple of the mean; ROUNDS go by between two tables.
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-4, 4
#: A host is blocked if its distrust is above this. A host that has no links but to blocked seeds, which have none, has
#: damping * (1 - damping) = 0.1275 in all, so this is about the third of its links. The bar is twice as high for hosts that have
#: the mean trust or more, and in between for those with less.
THRESHOLD = 0.04


def host_of(url: Column) -> Column:
    """The host in lower case (A to Z): after the first :// up to / ? # or the end; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by host and then by path; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the last to be applied wins
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from pages (host, html) to other hosts, counted by pair of hosts."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)\b(?:href|src|action)\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'>]+)"), F.lit(1))
    target = F.col("target")
    url = F.when(target.startswith("//"), F.concat(F.lit("http:"), target)).otherwise(target)
    links = pages.where(F.col("html").contains("//") & (F.col("host") != "")).select("host", F.explode(found).alias("target"))
    links = links.select(F.col("host").alias("src"), host_of(url).alias("dst")).where("dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(hosts: DataFrame, links: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust, bad, blocked: trust is a multiple of the mean, distrust a share from 0 to 1; blocked is the
    host's own, bad whether its distrust is above its bar.

    hosts: host, trusted, blocked (weights of the seeds, at most 1 for blocked ones). Both go in one iteration, over edges that
    carry which of the two they serve. What changes shrinks by the damping with each round, trust in all and distrust for
    each host, which bounds what is still to come: rounds go on until it can't change any verdict, or is within the tolerance.

    A host that very many link to sends along all those edges in the distrust's direction. Such hosts are few (their
    edges add up to no more than all); their ranks are broadcast, all others are shuffled.
    """
    sent = links.groupBy("src").agg(F.sum("n").alias("all"), F.count("*").alias("rows"))
    shares = scratch.table(lookup(links, sent, ["src"], "rows").select("src", "dst", (F.col("n") / F.col("all")).alias("w")), "shares")
    both = shares.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(
        shares.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "w")
    )
    out = scratch.table(both.groupBy("kind", "a").agg(F.count("*").alias("rows")), "out")
    limit = max(HOT_ROWS, (out.agg(F.sum("rows")).first()[0] or 0) // MAX_HOT_KEYS)
    edges = scratch.table(both, "edges")
    hot = scratch.table(out.where(F.col("rows") > limit).select("kind", "a"), "hot")  # MAX_HOT_KEYS rows at most
    hubs = hot.limit(1).count() > 0
    if hubs:
        many = scratch.table(edges.join(F.broadcast(hot), ["kind", "a"], "left_semi"), "many")
        few = scratch.table(edges.join(F.broadcast(hot), ["kind", "a"], "left_anti"), "few")
    linked = edges.select(F.col("a").alias("host")).unionByName(edges.select(F.col("b").alias("host"))).distinct()
    hosts = hosts.join(linked, "host", "full").na.fill({"trusted": 0.0, "blocked": 0.0})
    hosts = scratch.table(hosts, "hosts")
    n = float(hosts.count() or 1)
    seed = lambda kind, column: hosts.select(F.lit(kind).alias("kind"), "host", F.col(column).alias("seed"))
    seeds = scratch.table(seed("trust", "trusted").unionByName(seed("distrust", "blocked")).where("seed > 0"), "seeds")

    def onward(ranks: DataFrame) -> DataFrame:
        from_ = ranks.withColumnRenamed("host", "a")
        if hubs:
            of_hubs = F.broadcast(from_.join(F.broadcast(hot), ["kind", "a"], "left_semi"))
            met = many.join(of_hubs, ["kind", "a"]).unionByName(few.join(from_, ["kind", "a"]))
        else:
            met = edges.join(from_, ["kind", "a"])
        sent = met.groupBy("kind", F.col("b").alias("host")).agg((F.sum(F.col("rank") * F.col("w")) * damping).alias("sent"))
        rank = F.coalesce("sent", F.lit(0.0)) + F.coalesce("seed", F.lit(0.0))
        return sent.join(seeds, ["kind", "host"], "full").select("kind", "host", rank.alias("rank"))

    def judged(ranks: DataFrame, total: float) -> DataFrame:
        """Hosts that have a rank, with bar: how high their distrust may be."""
        mine = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
        # what trust reaches dead ends goes back to the seeds, in proportion: shares are ranks over their sum
        found = ranks.groupBy("host").agg((mine("trust") * (n / total)).alias("trust"), (mine("distrust") * (1 - damping)).alias("distrust"))
        return found.withColumn("bar", threshold * (1 + F.least(F.col("trust"), F.lit(1.0))))

    ranks = seeds.withColumnRenamed("seed", "rank")
    shrinks = damping**ROUNDS / (1 - damping**ROUNDS)
    total = 1.0
    for k in count():
        new = ranks
        for _ in range(ROUNDS):
            new = onward(new)
        new = scratch.table(new, f"ranks{k}")
        change = F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
        of = lambda kind, x: F.when(F.col("kind") == kind, x)
        moved = new.join(ranks.withColumnRenamed("rank", "old"), ["kind", "host"], "full").agg(
            F.sum(of("trust", change)).alias("trust"), F.max(of("distrust", change)).alias("distrust"), F.sum(of("trust", F.col("rank"))).alias("total")
        ).first()
        if k:
            scratch.drop(f"ranks{k - 1}")
        ranks, total = new, moved["total"] or 1.0
        # how far any host's trust and distrust may still move
        more_trust = 2 * (moved["trust"] or 0.0) * shrinks * n / total
        more_distrust = (moved["distrust"] or 0.0) * shrinks * (1 - damping)
        if more_trust <= tolerance and more_distrust <= tolerance:
            break
        near = F.abs(F.col("distrust") - F.col("bar")) <= more_distrust + threshold * min(more_trust, 1.0)
        if not judged(ranks, total).where(near).limit(1).count():
            break
    found = judged(ranks, total).select("host", "trust", "distrust", (F.col("distrust") > F.col("bar")).alias("bad"))
    return hosts.select("host", "blocked").join(found, "host", "left").na.fill(0.0).na.fill(False)


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every row of pages (page_id, url, html).

    The verdict is the rule's where one fits; else block if the host is a blocked seed, or if its distrust is above its bar
    (threshold, up to twice that with trust), else allow. Every seed weighs the same, so a host with very many pages changes
    nothing for what other seeds reach. A url that is null or has no :// has an empty host and path, no rule and no links, and is
    allowed. Pages without html give no links. Rows that repeat are judged alike.
    """
    scratch = Scratch(pages.sparkSession, "trust")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = scratch.table(rows.withColumns({"rule": rule, "ruled": verdict}), "rows")
    allowed, blocked = (F.count_if(F.col("ruled") == kind) for kind in ("allow", "block"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("rows"), allowed.alias("allowed"), blocked.alias("blocked"))
    hosts = scratch.table(hosts, "by_host")
    named = hosts.where("host <> ''")
    weight = lambda mine, other: F.when((F.col(mine) > F.col(other)) & (2 * F.col(mine) > F.col("rows")), 1.0).otherwise(0.0)
    seeds = named.select("host", weight("allowed", "blocked").alias("trusted"), weight("blocked", "allowed").alias("blocked"))
    links = scratch.table(host_links(pages.select(host.alias("host"), "html")), "links")
    ranks = scratch.table(spread(seeds, links, scratch, threshold), "ranks")
    ranks = ranks.select("host", "trust", "distrust", ((F.col("blocked") > 0) | F.col("bad")).alias("bad"))
    judged = scratch.table(hosts.select("host", "rows").join(ranks, "host", "left").na.fill(0.0).na.fill(False), "judged")
    found = lookup(rows, judged, ["host"], "rows")
    own = F.when(F.col("bad"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
