"""URL filter: host and path rules, and link-graph propagation for the urls that no rule decides.

Rules name a host and a path prefix; the longest that fits a url decides it. Other urls take the verdict of
their host in the link graph: trust is a personalised PageRank from hosts in proportion to their allowed pages
along the links between hosts, distrust one from hosts in proportion to their blocked pages against the links.
Only mass received over links counts, not the restart. A host whose distrust exceeds its trust and ``floor``
times the mean share of a host is blocked; all others are allowed. Mass is passed on until what is still to come,
over all hosts, is below ``tolerance`` times the floor of one host, so paths of any length that matters are followed.

Scale: pages are read once and reduced to counts of host links and of ruled pages per host; only these are
shuffled, pre-aggregated. Every ``cut`` steps the ranks are staged, so lineage stays short, and edges are staged,
so Spark splits a hub's edges in the joins. Rules are a short list in the plan.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule and are allowed; equal
rules: the first given decides; links of a host to itself and relative links are no edges; no edges: every
undecided url is allowed; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, ascii_lower, stage, with_columns_last

ADDED = ["host", "path", "rule", "verdict", "trust", "distrust"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(text: str) -> list[Rule]:
    """Rules from ``block net/, allow example.net/en/``."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        verdict, where = part.split()
        host, slash, path = where.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {part!r}")
        out.append(Rule(verdict, host, slash + path))
    return out


def url_host(url: Column) -> Column:
    rest = _after_scheme(url)
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):  # the last one laid on top is the longest
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of one host that link to another."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    absolute = F.array_distinct(F.transform(hrefs, lambda u: F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))
    some = pages.where(F.col("html").contains("//")).select(url_host(F.col("url")).alias("src"), F.explode(absolute).alias("to"))
    links = some.select("src", url_host(F.col("to")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, steps: int | None, cut: int = 5, least: float = 0.0) -> DataFrame:
    """(host, mass): what hosts receive over ``edges(src, dst, weight)`` in a PageRank from ``seeds(host, mass)``.

    After ``steps`` steps, or without them once the masses of two stagings differ by ``least`` or less in all: ``cut``
    steps shrink a difference to damping^cut, so that at 0.85 and 5 what is still to come is below 0.8 times that.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all")).withColumnRenamed("src", "__src")
    flow = stage(edges.join(out, edges["src"] == out["__src"]).select("src", "dst", (F.col("weight") / F.col("all")).alias("part")), "flow")
    start = stage(seeds.select("host", F.col("mass").alias("own")), "seeds")
    rank, kept = start.withColumnRenamed("own", "mass"), None
    got = None
    for step in count(1) if steps is None else range(1, steps + 1):
        got = flow.join(rank, flow["src"] == rank["host"]).groupBy("dst").agg((F.sum(F.col("mass") * F.col("part")) * damping).alias("mass"))
        got = got.withColumnRenamed("dst", "host")
        if step % cut == 0 and step != steps:
            fresh = Staged(got, "rank")
            got = fresh.df
            settled = steps is None and _difference(got, kept.df if kept else got.limit(0)) <= least
            if kept:
                kept.drop()
            kept = fresh
            if settled:
                break
        rank = got.select("host", "mass").unionByName(start.select("host", ((1 - damping) * F.col("own")).alias("mass"))).groupBy("host").agg(F.sum("mass").alias("mass"))
    return got.select("host", "mass")


def _difference(a: DataFrame, b: DataFrame) -> float:
    """The sum over hosts by how much their masses differ."""
    both = a.select("host", "mass").unionByName(b.select("host", (-F.col("mass")).alias("mass")))
    return both.groupBy("host").agg(F.abs(F.sum("mass")).alias("by")).agg(F.sum("by")).first()[0] or 0.0


def judge_urls(pages: DataFrame, rules: list[Rule], damping: float = 0.85, tolerance: float = 0.001, floor: float = 0.2) -> DataFrame:
    """``pages`` (without html) with host, path, rule, verdict, trust and distrust."""
    rest = [c for c in with_columns_last(pages, ADDED) if c != "html"]
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    own = pages.select(*rest, host.alias("host"), path.alias("path"))
    name, told = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": name, "__tm_told": told})

    edges = Staged(host_links(pages), "host-links")
    if not edges.df.limit(1).count():
        zero = F.lit(0.0)
        return own.select(*rest, "host", "path", "rule", F.coalesce("__tm_told", F.lit("allow")).alias("verdict"), zero.alias("trust"), zero.alias("distrust"))
    told_by_host = own.groupBy("host").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("__tm_told") == "allow", 1)).alias("good"), F.count(F.when(F.col("__tm_told") == "block", 1)).alias("bad")
    )
    hosts = stage(told_by_host.where("host <> ''"), "hosts")
    hosts_in_all, good, bad = hosts.agg(F.count("*"), F.sum(F.col("good") / F.col("n")), F.sum(F.col("bad") / F.col("n"))).first()
    seeds = lambda part, total: hosts.where(f"{part} > 0").select("host", (F.col(part) / F.col("n") / F.lit(float(total or 1.0))).alias("mass"))
    least = tolerance * floor / (hosts_in_all or 1)
    trust = propagate(edges.df, seeds("good", good), damping, None, least=least)
    back = edges.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, seeds("bad", bad), damping, None, least=least)
    both = trust.select("host", F.col("mass").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("mass").alias("distrust")))
    both = stage(both.groupBy(F.col("host").alias("__tm_host")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "trust")
    out = own.join(both, F.col("host") == F.col("__tm_host"), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    bad_host = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * float(hosts_in_all or 1) >= floor)
    verdict = F.coalesce("__tm_told", F.when(bad_host, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*rest, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
