"""URL filtering by rules and by trust propagated over the link graph between hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossia.llm.common import ascii_lower, cut, small

#: The value of an attribute href, in quotes of either kind or without; names that only end in href don't count.
HREF = r"""(?i)[\s"'/]href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ROUNDS = 12
DAMPING = 0.85
#: A host is blocked if its distrust exceeds this many times the larger of its trust and of what a walk from all pages gives it.
THRESHOLD = 1.0
#: Scores that differ by less than this share count as equal, so that the order of additions doesn't matter.
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null if none)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links from one host to another, counted over all pages. Links within a host don't count."""
    links = pages.select(host_path(F.col(url_col))[0].alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), 1)).alias("href"))
    links = links.withColumn("href", F.btrim("href", F.lit("\"'")))
    # ``//host/path`` takes the page's scheme; relative links stay within the host.
    target = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    links = links.where(F.col("href").contains("//")).select("src", host_path(target)[0].alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """kind, host, score: personalised PageRank for each kind of seeds.

    edges: kind, src, dst, w (w of one src and kind sum to 1); seeds: kind, host, seed (of one kind sum to 1). Mass that reaches a host without
    links ends there. So links elsewhere don't change the score of a host that they don't reach, and without any link
    scores are the seeds times 1 - damping, for every kind alike. Each round is a join and a sum that is pre-aggregated in each task; the edges of
    a hub are split among tasks where they are many.
    """
    edges, seeds = cut(edges), cut(seeds)
    score = seeds.select("kind", "host", F.col("seed").alias("score"))
    for k in range(rounds):
        moved = score.join(edges.withColumnRenamed("src", "host"), ["kind", "host"])
        moved = moved.select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("w") * damping).alias("score"))
        own = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
        score = moved.unionByName(own).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % 4 == 3 or k == rounds - 1:
            score = cut(score)
    return score


def judge_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD,
) -> DataFrame:
    """For each row of pages: id, host, path, rule, verdict, trust, distrust, usual.

    A page that a rule fits has the rule's verdict. For others the host decides: trust flows from hosts with allowed pages along
    links, distrust from hosts with blocked pages against them (who links to blocked hosts is distrusted). ``usual`` is what a walk from all pages
    gives the host on the same reversed links, so distrust is compared with its like: a host is blocked if its distrust exceeds ``threshold`` times the larger of
    its trust and usual (a large host, or one that links to many, isn't blocked for a few bad pages). A seed's weight is its number of pages of that kind. Hosts
    that distrust doesn't reach, and pages without a host, are allowed. Null html has no links; repeated rows give repeated results; an empty
    table gives an empty result; other columns of pages are not read.
    """
    cols = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    host, path = host_path(F.col("url"))
    judged = cols.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", text.alias("rule"), verdict.alias("by_rule"))

    # Trust follows links as they point, distrust and the walk from all pages go against them.
    edges = cut(host_edges(cols))
    forth = edges.select(F.lit("allow").alias("kind"), "src", "dst", "n")
    back = edges.select(F.explode(F.array(F.lit("block"), F.lit("page"))).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = cut(forth.unionByName(back))
    out = cut(both.groupBy("kind", "src").agg(F.sum("n").alias("of")))
    both = both.join(small(out), ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("of")).alias("w"))
    named, nameless = judged.where("host <> ''"), judged.where("host = ''")
    counts = named.where("by_rule is not null").groupBy(F.col("by_rule").alias("kind"), "host").agg(F.count("*").alias("n"))
    pages_of = named.groupBy("host").agg(F.count("*").alias("n")).select(F.lit("page").alias("kind"), "host", "n")
    counts = cut(counts.unionByName(pages_of))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("of"))
    seeds = counts.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("n") / F.col("of")).alias("seed"))  # three rows at most

    score = propagate(both, seeds, rounds, damping)
    of_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    hosts = score.groupBy("host").agg(of_kind("allow").alias("trust"), of_kind("block").alias("distrust"), of_kind("page").alias("usual"))
    hosts = cut(hosts)
    # Pages without a host stay out of the join; those of one host are split among tasks where they are many.
    judged = named.join(small(hosts), "host", "left").select("page_id", "host", "path", "rule", "by_rule", "trust", "distrust", "usual")
    judged = judged.unionByName(nameless, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    judged = judged.select("page_id", "host", "path", "rule", "by_rule", *map(zero, ("trust", "distrust", "usual")))
    bad = F.col("distrust") > F.lit(threshold * (1 + TOLERANCE)) * F.greatest("trust", "usual")
    verdict = F.coalesce("by_rule", F.when(bad, "block").otherwise("allow"))
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust", "usual")
