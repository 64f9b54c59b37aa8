"""URL filter: personalised PageRank from trusted hosts against reversed distrust from blocked ones."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crownlake.llm.common import stored

DAMPING, TOLERANCE = 0.85, 1e-6


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str = ""  # without its leading slash

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


RULES = (Rule("block", "com", "en/"), Rule("allow", "example.com", "en/7"), Rule("allow", "net", "de/"), Rule("block", "example.net", "de/8"), Rule("block", "org", "es/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    raw = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    return F.when(url.isNotNull() & (F.locate("://", url) > 0), _ascii_lower(raw)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(url.isNotNull() & (F.locate("://", url) > 0), F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rule_hosts(host: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether some rule speaks of the host, whatever the path."""
    found = F.lit(False)
    for r in rules:
        found = found | _under(host, r)
    return found


def _under(host: Column, rule: Rule) -> Column:
    return (host == rule.host) | host.endswith("." + rule.host)


def matched(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, action), or null. Equal lengths: the first in `rules`."""
    ranked = sorted(rules, key=lambda r: -len(r.text))
    out = None
    for r in ranked:
        fits = _under(host, r) & path.startswith("/" + r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> (src, dst, n): links between different hosts; a link without a host stays within its own."""
    link = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^\s"'<>/?#]+)"""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(link), F.lit(1))).alias("dst"))
    links = links.select("src", _ascii_lower(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank (host, rank) over edges (src, dst, n) from seeds (host); ranks sum to at most 1.

    Each round joins ranks with normalised edges and sums them by target before rows move; it is
    written to the shared folder, so a lost executor repeats one round at most. It ends once ranks
    move by less than `tolerance` in all: round k moves at most 2 * damping**k, which bounds the
    number of rounds (95 by default); a RuntimeError beyond it. Hosts without rank don't come out.
    """
    seeds = seeds.select("host").where("host <> ''").distinct()
    n = seeds.count()
    if not n:
        return seeds.select("host", F.lit(0.0).alias("rank"))
    restart = seeds.select("host", F.lit(1.0 / n).alias("rank"))
    if edges.isEmpty():
        return restart
    out_degree = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = stored(edges.join(out_degree, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    ranks = stored(restart, "ranks")
    for _ in range(math.ceil(math.log(tolerance / 4) / math.log(damping)) + 1):
        moved = share.join(ranks, share.src == ranks.host).select(F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
        back = restart.select("host", (F.col("rank") * (1 - damping)).alias("rank"))
        new = stored(moved.unionByName(back).groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
        change = new.withColumnRenamed("rank", "b").join(ranks.withColumnRenamed("rank", "a"), "host", "full")
        delta = change.agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).first()[0]
        ranks = new
        if delta < tolerance:
            return ranks
    raise RuntimeError(f"ranks still move by {delta}")


def host_scores(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, threshold: float = 0.0) -> DataFrame:
    """(host, trust, distrust, host_verdict) for each host that pages name.

    Seeds of trust are hosts with a page that a rule allows, seeds of distrust those with a page that
    a rule blocks. Trust follows links from trusted hosts; distrust follows them backwards, from a
    blocked host to those that link to it. Both are taken relative to their largest value. A host is
    blocked if distrust exceeds trust by more than `threshold`.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    acts = seen.select("host", matched(F.col("host"), F.col("path"), rules)["action"].alias("action"))
    hosts = stored(acts.groupBy("host").agg(F.max((F.col("action") == "allow").cast("int")).alias("allowed"), F.max((F.col("action") == "block").cast("int")).alias("blocked")), "hosts")
    edges = stored(host_edges(pages), "host-edges")
    trust = propagate(edges, hosts.where("allowed = 1"))
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), hosts.where("blocked = 1"))
    scaled = []
    for ranks, name in ((trust, "trust"), (distrust, "distrust")):
        top = ranks.agg(F.max("rank")).first()[0] or 1.0
        scaled.append(ranks.select("host", (F.col("rank") / top).alias(name)))
    out = hosts.select("host").join(scaled[0], "host", "left").join(scaled[1], "host", "left").fillna(0.0, ["trust", "distrust"])
    return out.withColumn("host_verdict", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, keep: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """keep (all columns of pages by default), host, path, rule, verdict, trust, distrust.

    The verdict is the longest fitting rule's, else the host's by link propagation. A null url, or
    one without ://, has an empty host and path, no rule, and the verdict of the empty host. Rows
    with equal urls are judged alike; result columns replace columns of their names.
    """
    new = {"host", "path", "rule", "verdict", "trust", "distrust"}
    names = [c for c in (keep or pages.columns) if c not in new]
    own = pages.select(*names, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("__m", matched(F.col("host"), F.col("path"), rules))
    both = own.join(host_scores(pages, rules, threshold=threshold), "host", "left")
    return both.select(
        *names, "host", "path", F.col("__m.rule").alias("rule"), F.coalesce(F.col("__m.action"), F.col("host_verdict"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
