"""URL filtering by rules and by trust that spreads over the link graph of hosts.

Personalised PageRank runs twice over the host edges: trust starts at hosts that allow rules cover and follows links;
distrust starts at hosts that block rules cover and follows links backwards, to those who link there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_names

#: Fixed value: an absolute or scheme-relative link in an attribute; the group is its host.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or url."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return _lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def host_edges(pages: DataFrame, url: str = "url", html: str = "html", site_edges: bool = True) -> DataFrame:
    """(src, dst, n): links between different hosts, counted over pages; partial sums before they move.

    With site_edges, a host and the nearest host above it that has pages of its own (`blog.a.org` and `a.org`) count as
    linked once in each direction.
    """
    host = host_of(F.col(url))
    links = pages.select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))).alias("dst"))
    edges = links.select("src", _lower(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    if site_edges:
        hosts = pages.select(host.alias("h")).distinct()
        labels = F.split("h", "\\.")
        ups = hosts.select("h", F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(labels))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("k", "up"))
        near = ups.where("up <> ''").join(hosts.select(F.col("h").alias("up")), "up").groupBy("h").agg(F.min_by("up", "k").alias("up"))
        edges = edges.unionByName(near.select(F.col("h").alias("src"), F.col("up").alias("dst"), F.lit(1).cast("long").alias("n")))
        edges = edges.unionByName(near.select(F.col("up").alias("src"), F.col("h").alias("dst"), F.lit(1).cast("long").alias("n")))
    return edges.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, cut_every: int = 5) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trusted, blocked; shares of at least 0).

    Each column is a personalised PageRank of total at most the sum of its seeds, its restarts dealt by the seeds: it is not
    divided by that sum, so a host's values depend on the seeds around it and not on the size of the table. Trust follows
    edges, distrust goes against them. What a host without edges would pass on is lost to restarts. Both run in one
    join for each round; lineage is cut every few rounds. Without seeds of a kind, that column is 0.
    """
    both = edges.select(F.lit(0).alias("ch"), "src", "dst", "n").unionByName(edges.select(F.lit(1).alias("ch"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("ch", "src").agg(F.sum("n").alias("all"))
    both = materialize(both.join(out, ["ch", "src"]).select("ch", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "edges")
    start = None
    for ch, c in enumerate(("trusted", "blocked")):
        part = seeds.where(F.col(c) > 0).select(F.lit(ch).alias("ch"), "host", F.col(c).cast("double").alias("s"))
        start = part if start is None else start.unionByName(part)
    start = materialize(start, "start")
    rank = start.select("ch", "host", F.col("s").alias("r"))
    for k in range(1, rounds + 1):
        moved = rank.join(both.withColumnRenamed("src", "host"), ["ch", "host"]).groupBy("ch", F.col("dst").alias("host")).agg(F.sum(F.col("r") * F.col("w")).alias("m"))
        parts = moved.select("ch", "host", (F.col("m") * damping).alias("r")).unionByName(start.select("ch", "host", (F.col("s") * (1 - damping)).alias("r")))
        rank = parts.groupBy("ch", "host").agg(F.sum("r").alias("r"))
        if k % cut_every == 0 or k == rounds:
            rank = materialize(rank, "rank")
    of = lambda ch: F.coalesce(F.sum(F.when(F.col("ch") == ch, F.col("r"))), F.lit(0.0))
    return rank.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (`host/path`, verdict) that fits, as struct(rule, verdict), or null. A rule fits its host and all
    subdomains, where the url's path starts with the rule's. `rules` is configuration: it becomes part of the plan."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(set(rules), key=lambda r: (len(r[0]), r), reverse=False):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", threshold: float = 1e-4, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """pages without the html, with host, path, rule, verdict (allow or block), trust and distrust.

    The verdict is the fitting rule's. Elsewhere the host is blocked if its distrust is at least `threshold` (on the scale
    of the seeds, whatever the size of the table) and more than its trust. Each host is a seed of trust and of distrust by the shares of its pages that rules allow and block. A null url, or one
    without `://`, has an empty host and path, no seed and no links, and is allowed; a null html has no links. Repeated
    pages count again; columns of these names are replaced, others stay; an empty table gives no rows. A host with a
    third of all pages is summed partially before it moves, and its pages meet its ranks in a join that AQE can split.
    """
    new = ["host", "path", "rule", "verdict", "trust", "distrust"]
    return own_names(pages, {"url": url, "html": html}, new, lambda inner, url, html: _judge_pages(inner, rules, url, html, threshold, damping, rounds))


def _judge_pages(pages: DataFrame, rules: list[tuple[str, str]], url: str, html: str, threshold: float, damping: float, rounds: int) -> DataFrame:
    u = F.col(url)
    judged = pages.select(*[c for c in pages.columns if c != html], host_of(u).alias("host"), path_of(u).alias("path"))
    r = matching_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("__r", r)
    seen = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.col("__r.verdict") == v).alias(v) for v in ("allow", "block")])
    seeds = materialize(seen.select("host", (F.col("allow") / F.col("n")).alias("trusted"), (F.col("block") / F.col("n")).alias("blocked")), "seeds")
    ranks = materialize(propagate(host_edges(pages, url, html), seeds, damping, rounds), "ranks")
    out = judged.join(ranks, "host", "left")
    trust, distrust = (F.round(F.coalesce(c, F.lit(0.0)), 9) for c in ("trust", "distrust"))
    own = F.when((distrust >= threshold) & (distrust > trust), F.lit("block")).otherwise(F.lit("allow"))
    kept = [c for c in judged.columns if c not in ("host", "path", "__r")]
    return out.select(*kept, "host", "path", F.col("__r.rule").alias("rule"), F.coalesce(F.col("__r.verdict"), own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
