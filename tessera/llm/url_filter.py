"""URL rules, and link-graph propagation for the pages on which no rule decides.

Personalised PageRank carries trust along the links from hosts whose pages the rules allow; the same walk
over reversed links carries distrust back from hosts whose pages the rules block. A host is blocked where
its distrust less its trust, per page of its own, reaches the threshold.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, stored

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-6


def _az_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(_az_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; null where none fits."""
    fits = []
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        on_host = (host == rule_host) | host.endswith(f".{rule_host}")
        fits.append((on_host & path.startswith(rule_path), rule_host + rule_path, verdict))
    pick = lambda k: reduce(lambda c, f: c.when(f[0], F.lit(f[k])), fits[1:], F.when(fits[0][0], F.lit(fits[0][k])))
    return pick(1), pick(2)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. A relative link stays on its host and is no edge."""
    link = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1)))
    target = F.regexp_extract("link", r"//([^/?#]*)", 1)
    links = pages.where(F.contains("html", F.lit("//")) & (F.col("host") != "")).select(F.col("host").alias("src"), link.alias("link"))
    return links.select("src", _az_lower(target).alias("dst")).where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, mass), in units of seed mass.

    A walker at a host without links goes home: its mass leaves the walk. Ends once a pass changes no more
    than a millionth of the mass, or after the given rounds.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = checkpoint(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    score = seeds.select("host", F.col("mass").alias("score"))
    if shares.isEmpty():
        return score
    whole = seeds.agg(F.sum("mass")).first()[0] or 0.0
    for k in count() if rounds is None else range(rounds):
        moved = shares.join(score, shares.src == score.host).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("share") * F.col("score"))).alias("score"))
        new = seeds.select("host", F.col("mass").alias("score")).unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 5 == 4:
            new = checkpoint(new)
            change = new.join(score.withColumnRenamed("score", "old"), "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            if (change or 0.0) <= TOLERANCE * max(whole, 1e-300):
                return new
        score = new
    return score


def host_verdicts(judged: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, blocked) from pages (host, ruled) and the edges between hosts."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").cast("double").alias("allowed"), F.count_if(F.col("ruled") == "block").cast("double").alias("denied"))
    hosts = checkpoint(hosts)
    edges = checkpoint(edges)
    trust = propagate(edges, hosts.where("allowed > 0").select("host", F.col("allowed").alias("mass")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, hosts.where("denied > 0").select("host", F.col("denied").alias("mass")))
    both = hosts.join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    both = both.na.fill(0.0, ["trust", "distrust"])
    return both.select("host", "trust", "distrust", (((F.col("distrust") - F.col("trust")) / F.col("pages")) >= threshold).alias("blocked"))


def url_filter(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every page: (page_id, host, path, rule, verdict).

    A rule's verdict holds where a rule fits (the longest wins); elsewhere the host's. A null url, or one
    without ``://``, has an empty host, which no link reaches: allow. A null html has no links. Repeated
    pages are judged each, and each counts as a page of its host. A host whose distrust less trust is the threshold exactly is
    blocked. Urls and html of any length are read whole; extra columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))
    # Stored, so that the join may broadcast a small list of hosts and else split the pages of a large host.
    blocked = stored(host_verdicts(judged, host_edges(base), threshold).where("blocked AND host <> ''").select("host", F.lit("block").alias("linked")))
    return judged.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "linked", F.lit("allow")).alias("verdict"))
