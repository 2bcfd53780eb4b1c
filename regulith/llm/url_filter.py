"""URL filters: block and allow rules, and what links say of the hosts that no rule judges.

Hosts that allow rules fit are trusted seeds, those that block rules fit are
blocked seeds, each in the share of its pages that they fit. Trust flows along
links as personalised PageRank from the trusted seeds; distrust flows against
links from the blocked seeds, so that a host which links to bad hosts gets it.

What a host gets depends on how many others link to it or to what it links to, so both flows
are measured against the same flow of everything that can be known: mass from every judged host, and from
every host where links begin (for trust) or end (for distrust). Trust and distrust become shares of it, from 0
to 1, whatever the number of links: a host that links to nothing but a blocked host has the share 1 as one of
ten as well as alone. A host is blocked if its share of distrust exceeds its share of trust by more than ``threshold``.

Edges between hosts carry their number of links. The flows are one table of
arcs, and a round is one join and one sum in Spark. Scores are whole numbers of
1e-12, so that rounds don't depend on the order of summing. Each round is a
written table, which replaces the one before; a host with very many arcs is a
skewed partition of a join of two plain exchanges, which Spark splits. Rounds go on
until the flows stand still: damping shrinks the change of each round, so their
number depends on damping and tolerance and not on the graph.

Defined results: a null url or one without "://" has empty host and path, fits
no rule and is allowed, as is a page whose host nothing is known of. Null html
has no links, and html of any length is read whole. A null id is an id like
others. Links to the own host don't count. What a host without outgoing
arcs holds flows nowhere. Repeated rows are pages of their own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch, written

UNIT = 1_000_000_000_000
SCORES = ("trust", "distrust", "trust_share", "distrust_share")
#: The host of an absolute link of an element that leads to, belongs to or embeds another page.
LINK = r"""(?i)<(?:a|area|base|link|form|i?frame|source)\b(?:[^>]*?[\s"'/])?(?:href|action|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower(host), path


def fits(rule: str, host: Column, path: Column) -> Column:
    name, _, tail = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))


def matching_rule(rules: dict[str, str], host: Column, path: Column) -> Column:
    """The longest rule that fits (the first by code point of several), or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        out = F.when(fits(rule, host, path), F.lit(rule)).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: Column, html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, from absolute links of anchors, areas, forms, frames, sources, and base and link elements."""
    linked = F.explode(F.regexp_extract_all(F.coalesce(html_col, F.lit("")), F.lit(LINK), F.lit(1)))
    pairs = pages.select(host.alias("src"), linked.alias("dst")).withColumn("dst", lower(F.col("dst")))
    return pairs.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust, trust_share, distrust_share) from edges (src, dst, links) and seeds (host, trusted, blocked: shares of 1).

    The flows are trust (0) and all that can be known (2) along links, distrust (1) and all that can be known (3) against them.
    Rounds end when the flows change by less than ``tolerance`` of what their seeds hold; or after ``rounds``, where given.
    """
    spark = edges.sparkSession
    folder = scratch(spark, "hosts")
    outward = edges.groupBy("src").agg(F.sum("links").alias("all"))
    inward = edges.groupBy("dst").agg(F.sum("links").alias("all"))
    forth = edges.join(outward, "src").select(F.lit(0).alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("links") / F.col("all")).alias("part"))
    back = edges.join(inward, "dst").select(F.lit(1).alias("way"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("links") / F.col("all")).alias("part"))
    arcs = written(forth.union(back), f"{folder}/arcs")
    begins = outward.join(inward, F.col("src") == F.col("dst"), "left_anti").select(F.lit(2).alias("kind"), F.col("src").alias("host"))
    ends = inward.join(outward, F.col("src") == F.col("dst"), "left_anti").select(F.lit(3), "dst")
    judged = seeds.where("trusted + blocked > 0").select(F.explode(F.array(F.lit(2), F.lit(3))), "host")
    known = begins.union(ends).union(judged).distinct().select("kind", "host", F.lit(UNIT).alias("mass"))
    stacked = seeds.select("host", F.expr(f"stack(2, 0, cast(trusted * {UNIT} as long), 1, cast(blocked * {UNIT} as long)) as (kind, mass)"))
    held = written(stacked.where("mass > 0").select("kind", "host", "mass").union(known), f"{folder}/seeds")
    total = held.agg(F.coalesce(F.sum(F.col("mass").cast("double")), F.lit(0.0))).first()[0]
    now, i = written(held, f"{folder}/0"), 0
    moving = held.where("kind < 2").take(1) and arcs.take(1)
    while moving and (rounds is None or i < rounds):
        i += 1
        moved = now.join(arcs, (now.kind % 2 == arcs.way) & (now.host == arcs.a)).select("kind", F.col("b").alias("host"), F.floor(F.col("mass") * F.col("part") * damping).alias("mass"))
        summed = held.union(moved).withColumn("was", F.lit(0).cast("long")).union(now.select("kind", "host", F.lit(0).cast("long"), "mass"))
        both = written(summed.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was")), f"{folder}/{i}")
        after, change = both.select("kind", "host", "mass"), F.abs(F.col("mass") - F.col("was")).cast("double")
        flown = both.agg(F.coalesce(F.sum(change), F.lit(0.0))).first()[0]
        drop(spark, f"{folder}/{i - 1}")
        now, moving = after, flown > tolerance * total
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)) / UNIT
    flows = now.groupBy("host").agg(*(score(k).alias(f"f{k}") for k in range(4)))
    part = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(1.0), F.col(a) / F.col(b))).otherwise(0.0)
    return flows.select("host", F.col("f0").alias("trust"), F.col("f1").alias("distrust"), part("f0", "f2").alias("trust_share"), part("f1", "f3").alias("distrust_share"))


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, **how) -> DataFrame:
    """Per page: id, host, path, rule, verdict ("allow" or "block"), trust and distrust of its host, and their shares.

    ``rules``: rule, as host with path prefix ("example.net/en/"), → verdict.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "urls")
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("rule", matching_rule(rules, F.col("host"), F.col("path")))
    ruling = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()), F.lit(None).cast("string"))
    judged = judged.withColumn("ruling", ruling)
    seeds = judged.where("host <> ''").groupBy("host").agg((F.count_if(F.col("ruling") == "allow") / F.count("*")).alias("trusted"), (F.count_if(F.col("ruling") == "block") / F.count("*")).alias("blocked"))
    edges = written(host_edges(pages, host, html_col), f"{folder}/edges")
    scores = propagate(edges, seeds.where("trusted > 0 or blocked > 0"), **how)
    scores = written(scores.select(F.col("host").alias("h"), *SCORES), f"{folder}/scores")
    out = judged.join(scores, judged.host == scores.h, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in SCORES})
    own = F.when(F.col("distrust_share") - F.col("trust_share") > threshold, F.lit("block")).otherwise("allow")
    return out.select(id_col, "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), *SCORES)
