"""Allow and block verdicts for pages: rules first, then trust over the link graph of hosts.

A rule (host, path) fits its host and all subdomains where the path starts with
the rule's; the longest that fits decides.  For the other pages the host
decides, by two figures between 0 and 1.

Trust is personalised PageRank from the hosts that rules allow, weighted by the
allowed share of their pages, over the edges.  Ranks are split among the hosts
that one links to and so depend on how many there are; uniform PageRank over the
same edges is split in the same way, and the share of what reaches a host by
links that stems from trusted seeds does not depend on numbers.

Distrust goes back from the hosts that rules block over the reversed edges: a
host takes DAMPING times the link-weighted average of those it links to.  That
is the same random surfer seen from his start: the figure is what personalised
PageRank from this host (over 1 - DAMPING) puts on blocked pages.  It does not
depend on how many others link to the same blocked host, as the rank of a walk
from there over reversed edges would.

Both hold for the share of a host's pages that no rule decides; the shares that
rules allow and block count in full, so a host with more than half of its pages
blocked is blocked whatever links say.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.runtime import Lookup, checkpointed, written_table

DAMPING = 0.85
#: Steps end when no distrust, or the ranks by this share of all, change by more; ranks also after so many steps.
TOLERANCE = 1e-4
MAX_ITERATIONS = 25
#: A host is blocked if its distrust is at least this and above its trust.
BLOCK_AT = 0.5

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _CAPITALS, _SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: list[Rule], host: Column, path: Column) -> Column:
    """A struct (name, verdict) of the longest fitting rule, of the first by name among equally long ones; or null."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links): links between different hosts; relative ones stay on their host."""
    pattern = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
    linked = pages.filter(F.col(html).contains("//")).select(
        host_of(F.col(url)).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias("dst"))
    linked = linked.select("src", F.translate("dst", _CAPITALS, _SMALL).alias("dst"))
    return linked.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, weights: list[str], damping: float = DAMPING, tolerance: float = TOLERANCE,
              max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """host and, under the names of ``weights``, ranks of personalised PageRank over (src, dst, links).

    Every weight column of ``seeds`` is a personalisation of its own; all go
    along in one walk.  Each step sends a host's ranks on in proportion to its
    links.  What a host without links would pass on is dropped, which scales a
    vector of ranks as a whole.  Hosts that nothing reaches are left out.
    """
    out_links = edges.groupBy("src").agg(F.sum("links").alias("all"))
    flows = edges.join(out_links, "src").select("src", "dst", (F.col("links") / F.col("all") * damping).alias("share"))
    flows = written_table(flows, "flows")
    jumps = seeds.groupBy("host").agg(*[((1 - damping) * F.sum(w)).alias(w) for w in weights])
    jumps = checkpointed(jumps.filter(" OR ".join(f"{w} > 0" for w in weights)))
    whole = jumps.agg(*[F.sum(w) for w in weights]).first()
    ranks = jumps
    for _ in range(max_iterations):
        moved = ranks.join(flows, ranks["host"] == flows["src"]).select(F.col("dst").alias("host"), *[(F.col(w) * F.col("share")).alias(w) for w in weights])
        following = checkpointed(moved.unionByName(jumps).groupBy("host").agg(*[F.sum(w).alias(w) for w in weights]))
        both = following.unionByName(ranks.select("host", *[(-F.col(w)).alias(w) for w in weights]))
        changes = both.groupBy("host").agg(*[F.sum(w).alias(w) for w in weights]).agg(*[F.sum(F.abs(w)) for w in weights]).first()
        ranks = following
        if all((change or 0.0) <= tolerance * (total or 0.0) for change, total in zip(changes, whole)):
            break
    return ranks


def averaged(edges: DataFrame, own: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): weights carried back over the edges, rank = weight + rest x damping x the average rank of the hosts linked to.

    ``own`` has (host, weight, rest) of hosts; one that it lacks has weight 0 and
    rest 1.  A step shrinks all differences by ``damping``, so steps end by
    themselves.  Hosts of rank 0 are left out.
    """
    out_links = edges.groupBy("src").agg(F.sum("links").alias("all"))
    rest = own.select(F.col("host").alias("src"), "rest")
    flows = edges.join(out_links, "src").join(rest, "src", "left").select(
        "src", "dst", (F.coalesce("rest", F.lit(1.0)) * damping * F.col("links") / F.col("all")).alias("share"))
    flows = written_table(flows.filter("share > 0"), "averages")
    base = checkpointed(own.filter("weight > 0").select("host", F.col("weight").alias("rank")))
    ranks = base
    while True:
        moved = ranks.join(flows, ranks["host"] == flows["dst"]).select(F.col("src").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        following = checkpointed(moved.unionByName(base).groupBy("host").agg(F.sum("rank").alias("rank")))
        both = following.unionByName(ranks.select("host", (-F.col("rank")).alias("rank")))
        change = both.groupBy("host").agg(F.sum("rank").alias("d")).agg(F.max(F.abs("d"))).first()[0] or 0.0
        ranks = following
        if change <= tolerance:
            return ranks


def host_trust(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html") -> DataFrame:
    """(host, trust, distrust) of every host that has a page, a link or is linked to."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    ruled = pages.select(host.alias("host"), rule_for(rules, host, path)["verdict"].alias("verdict"))
    share = [F.coalesce(F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0)), F.lit(0.0)).alias(v) for v in ("allow", "block")]
    seeds = checkpointed(ruled.filter("host <> ''").groupBy("host").agg(*share))
    edges = written_table(host_edges(pages, url, html), "edges")
    if edges.isEmpty():  # all hosts keep their seed
        return seeds.select("host", F.col("allow").alias("trust"), F.col("block").alias("distrust"))
    rest = F.greatest(1 - F.col("allow") - F.col("block"), F.lit(0.0))
    distrust = averaged(edges, seeds.select("host", F.col("block").alias("weight"), rest.alias("rest"))).withColumnRenamed("rank", "distrust")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = checkpointed(seeds.join(linked, "host", "full").select(
        "host", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("allow", "block")], F.lit(1.0).alias("any")))
    ranks = propagate(edges, hosts, ["allow", "any"]).select("host", F.col("allow").alias("from_trusted"), F.col("any").alias("from_all"))
    # What came by links is the rank without the host's own jump.
    share = F.try_divide(F.col("from_trusted") - (1 - DAMPING) * F.col("allow"), F.col("from_all") - (1 - DAMPING))
    reached = F.col("from_all") > (1 - DAMPING) * (1 + 1e-9)
    trust = F.col("allow") + F.when(reached, rest * DAMPING * F.greatest(share, F.lit(0.0))).otherwise(0.0)
    both = hosts.join(ranks, "host", "left").join(distrust, "host", "left")
    return both.select("host", trust.alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", block_at: float = BLOCK_AT) -> DataFrame:
    """All columns but the page's html, and host, path, rule, verdict, trust and distrust.

    A null url and one without ``://`` have an empty host and path, no rule and
    the verdict allow.  A null html has no links.  A host that no seed reaches
    has trust and distrust 0 and is allowed.  Repeated rows are pages of their
    own: they stay, and count in their host's shares and links.  Whole texts are
    searched for links, however long.  No pages give no rows.
    """
    new = ("host", "path", "rule", "verdict", "trust", "distrust", "__rule")
    trust = Lookup(host_trust(pages, rules, url, html))
    rows = pages.drop(html, *[c for c in new if c not in (url, html)])
    rows = rows.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rows = rows.withColumn("__rule", rule_for(rules, F.col("host"), F.col("path")))
    rows = trust.join(rows, {"host": "host"}, {"trust": "trust", "distrust": "distrust"})
    trust_of, distrust_of = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when((distrust_of >= block_at) & (distrust_of > trust_of), "block").otherwise("allow")
    return rows.withColumns({
        "rule": F.col("__rule")["name"], "verdict": F.coalesce(F.col("__rule")["verdict"], by_host), "trust": trust_of, "distrust": distrust_of,
    }).drop("__rule")
