"""URL verdicts from rules and from trust and distrust spread over the host graph."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.plans.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""

TOLERANCE = 5e-14  # summed change of a walk's scores; what is left is 0.85 / 0.15 of it, below half the 12th digit

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    The rules are a parameter and part of the plan; nothing is joined.
    """
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))

    def fits(rule: Rule) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    found = [F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in longest]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, weight``: links between different hosts, one row per pair, weighted by their number."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(html_col, F.lit(LINK), 1)).alias("_link"))
    target = F.when(F.col("_link").startswith("//"), F.concat(F.lit("http:"), F.col("_link"))).otherwise(F.col("_link"))
    return (
        links.select("src", host_of(target).alias("dst"))
        .filter("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("weight"))
    )


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """``walk, host, score``: personalised PageRank of every walk at once.

    ``edges`` has ``walk, src, dst, weight`` and ``seeds`` ``walk, host, mass``
    (one row per host, positive). A round sends each host's score along its
    links by weight; what is lost at hosts without links, and the share 1 -
    damping, goes back to the seeds of the walk, so that the scores of a walk add up to 1. Sums are
    combined before they are shuffled, so a host that everybody links to is
    not gathered; every round is a written table. Rounds go on until the scores
    of no walk change by more than `TOLERANCE` in sum, or to the number of
    ``rounds`` if one is given.
    """
    total = seeds.groupBy("walk").agg(F.sum("mass").alias("_all"))
    start = materialize(seeds.join(total, "walk").select("walk", "host", (F.col("mass") / F.col("_all")).alias("seed")), "seeds")
    out = edges.groupBy("walk", "src").agg(F.sum("weight").alias("_out"))
    steps = materialize(
        edges.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("weight") / F.col("_out")).alias("part")), "steps"
    )
    scores = start.select("walk", "host", F.col("seed").alias("score"))
    if not steps.take(1):
        return scores
    for _ in count() if rounds is None else range(rounds):
        moved = (
            steps.join(scores.withColumnRenamed("host", "src"), ["walk", "src"])
            .groupBy("walk", F.col("dst").alias("host"))
            .agg((F.sum(F.col("score") * F.col("part")) * damping).alias("score"))
        )
        moved = materialize(moved, "moved")
        kept = moved.groupBy("walk").agg(F.sum("score").alias("_kept"))
        back = start.join(kept, "walk", "left").select(
            "walk", "host", (F.col("seed") * (F.lit(1.0) - F.coalesce("_kept", F.lit(0.0)))).alias("score")
        )
        before = scores.select("walk", "host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
        after = moved.unionByName(back).withColumn("before", F.lit(0.0)).unionByName(before)
        after = materialize(after.groupBy("walk", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "scores")
        # a host that only the round before reached has the score 0 and counts as change
        scores = after.select("walk", "host", "score")
        if rounds is None:
            change = after.groupBy("walk").agg(F.sum(F.abs(F.col("score") - F.col("before"))).alias("c")).agg(F.max("c")).first()[0]
            if (change or 0.0) <= TOLERANCE:
                break
    return scores


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    rounds: int | None = None,
    margin: float = 0.0,
) -> DataFrame:
    """``id_col, host, path, rule, verdict, trust, distrust`` for every page.

    A rule decides where one fits. Elsewhere the host decides: trust is a
    personalised PageRank from the hosts of allowed pages along the links,
    distrust one from the hosts of blocked pages against the links (who links to
    the blocked is suspect), seeds weighted by their number of pages; a host is
    blocked if its distrust exceeds its trust by more than ``margin``. Hosts
    that neither walk reaches are allowed. Scores are compared after rounding to
    12 digits. Null urls and urls without ``://`` have the empty host, which
    has no rule and no links; null html has no links. Rows, repeated ones too,
    are kept as they are; an empty table gives an empty result.
    """
    judged = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.withColumn("found", rule_column(F.col("host"), F.col("path"), rules))
    judged = materialize(judged.select("id", "host", "path", "found.rule", F.col("found.verdict").alias("ruled")), "judged")
    seeds = (
        judged.filter("ruled is not null and host <> ''")
        .groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("walk"), "host")
        .agg(F.count("*").alias("mass"))
    )
    edges = materialize(host_edges(pages, url_col, html_col), "edges")
    both = edges.select(F.lit("trust").alias("walk"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    scores = spread(both, seeds, damping, rounds)
    score = lambda walk: F.round(F.sum(F.when(F.col("walk") == walk, F.col("score")).otherwise(0.0)), 12)
    hosts = materialize(scores.groupBy("host").agg(score("trust").alias("trust"), score("distrust").alias("distrust")), "hosts")
    by_host = F.when(F.col("distrust") - F.col("trust") > margin, "block").otherwise("allow")
    return judged.join(hosts, "host", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
