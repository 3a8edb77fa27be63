"""Crawling over stored pages: de-duplication, robots rules, the frontier, breadth-first expansion."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.functions import urls as U
from termforge.functions.constants import MAX_DEPTH
from termforge.sources.shared import cut

ROBOT = "termforge"


def dedup_urls(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, norm_url): the first page of each normalised URL."""
    named = pages.select(id_col, U.normalize_url(F.col("url")).alias("norm_url"))
    return named.groupBy("norm_url").agg(F.min(id_col).alias(id_col))


def content_hash(content: Column) -> Column:
    """SHA-256 of the lower-cased text with single spaces."""
    return F.sha2(T.collapse(F.lower(content)), 256)


def dedup_content(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(content_hash, doc_id, copies): the first document of each content. Only hashes are shuffled."""
    hashed = docs.select("doc_id", content_hash(F.col(text_col)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@dataclass
class RobotRules:
    """Allowed prefixes win over disallowed ones, whatever their length; anything else is allowed."""

    allow: list[str] = field(default_factory=list)
    disallow: list[str] = field(default_factory=list)
    delay: float = 0.0

    def allows(self, path: str) -> bool:
        return any(map(path.startswith, self.allow)) or not any(map(path.startswith, self.disallow))


def parse_robots(text: str | None, robot: str = ROBOT) -> RobotRules:
    """All groups for ``*`` or ``robot`` together; of several agent lines in a row the last one decides."""
    rules, ours = RobotRules(), False
    for line in (text or "").splitlines():
        name, colon, value = line.strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or name.startswith("#"):
            continue
        if name == "user-agent":
            ours = value == "*" or robot in value.lower()
        elif ours and value and name in ("allow", "disallow"):
            getattr(rules, name).append(value)
        elif ours and name == "crawl-delay":
            try:
                rules.delay = float(value)
            except ValueError:
                continue
    return rules


def robots_table(files: DataFrame, robot: str = ROBOT) -> DataFrame:
    """(host, allow, disallow, delay) from (host, content)."""

    @F.pandas_udf("struct<allow:array<string>,disallow:array<string>,delay:double>")
    def parse(content: pd.Series) -> pd.DataFrame:
        found = [parse_robots(c, robot) for c in content]
        return pd.DataFrame({"allow": [r.allow for r in found], "disallow": [r.disallow for r in found], "delay": [r.delay for r in found]})

    return files.select("host", parse("content").alias("r")).select("host", "r.*")


def fresh_robots(files: DataFrame, now, ttl: str = "INTERVAL 1 HOUR") -> tuple[DataFrame, DataFrame]:
    """Of robots files (host, content, fetched_at): each host's last one if it isn't older than ``ttl`` at the time ``now``; and (host) to be fetched again."""
    last = files.groupBy("host").agg(F.max_by("content", "fetched_at").alias("content"), F.max("fetched_at").alias("fetched_at"))
    fresh = F.col("fetched_at") >= F.lit(now) - F.expr(ttl)
    return last.where(fresh), last.where(~F.coalesce(fresh, F.lit(False))).select("host")


def robots_filter(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """``urls`` with ``allowed``; hosts without rules allow all."""
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    joined = urls.withColumns({"host": U.host(F.col("url")), "path": path}).join(robots, "host", "left")
    none = F.array().cast("array<string>")
    starts = lambda c: F.exists(F.coalesce(c, none), lambda p: F.startswith("path", p))
    return joined.withColumn("allowed", starts(F.col("allow")) | ~starts(F.col("disallow"))).drop("allow", "disallow", "delay")


def schedule(frontier: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``frontier`` (url, priority, depth) with ``slot``: a host's urls come one per slot, the best first.

    All urls of a slot can be fetched at once; between two slots lies each host's delay. Ties go by the other columns.
    """
    others = [c for c in frontier.columns if c not in ("priority", "url")]
    order = Window.partitionBy("host").orderBy(F.desc("priority"), "url", *others)
    kept = frontier.where(F.col("depth") <= max_depth).withColumn("host", U.host(F.col("url")))
    return kept.withColumn("slot", F.row_number().over(order))


def link_graph(pages: DataFrame) -> DataFrame:
    """(page_id, target): all links of all pages, repeated ones too."""
    return pages.select("page_id", F.explode(U.page_links("html", "url")).alias("target"))


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(src, dst): links whose target is exactly a page's URL."""
    known = pages.select(F.col("url").alias("target"), F.col("page_id").alias("dst"))
    return links.join(known, "target").select(F.col("page_id").alias("src"), "dst")


def crawl(pages: DataFrame, seeds: DataFrame, links: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(page_id, depth): pages reached from ``seeds`` (page_id) over ``links`` (src, dst), at their least depth.

    A job for each level; a level's pages that were seen before are left out by an anti-join.
    """
    known = pages.select("page_id")
    seen = cut(seeds.join(known, "page_id", "left_semi").distinct().withColumn("depth", F.lit(0)))
    level = seen
    for depth in range(1, max_depth + 1):
        found = links.join(level.select(F.col("page_id").alias("src")), "src").select(F.col("dst").alias("page_id")).distinct()
        level = cut(found.join(known, "page_id", "left_semi").join(seen, "page_id", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
