"""Pages from the web, and crawls level by level over any source of pages."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.functions import urls as U
from termforge.functions.constants import MAX_DEPTH
from termforge.operators import crawl
from termforge.sources.shared import cut

FETCHED = "url string, status int, content_type string, html string, attempts int, error string, fetched_at timestamp"
Fetch = Callable[[DataFrame], DataFrame]


def fetch_one(url: str, timeout: float, retries: int, backoff: float, robot: str, wait: Callable[[float], None] = time.sleep) -> tuple:
    """A row of ``FETCHED``. What may pass (no answer, 429, 5xx) is tried again, after ``backoff`` seconds at first and twice as long each time."""
    status = kind = html = error = None
    for attempt in range(1, retries + 2):
        status = kind = html = error = None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": robot}), timeout=timeout) as answer:
                status, kind = answer.status, answer.headers.get_content_type()
                html = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
            break
        except urllib.error.HTTPError as e:
            status, error = e.code, str(e)
            if e.code != 429 and e.code < 500:
                break
        except (OSError, ValueError, LookupError) as e:
            error = f"{type(e).__name__}: {e}"
            if isinstance(e, ValueError):
                break
        if attempt <= retries:
            wait(backoff * 2 ** (attempt - 1))
    return url, status, kind, html, attempt, error, datetime.now(timezone.utc).replace(tzinfo=None)


def fetch(urls: DataFrame, delay: float = 1.0, timeout: float = 10.0, retries: int = 2, backoff: float = 0.5, robot: str = crawl.ROBOT) -> DataFrame:
    """``FETCHED`` for each row of ``urls`` (url, and delay, which may be null). A host's pages are one task's, ``delay`` seconds apart."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for pdf in batches:
            for url, host, own in zip(pdf["url"], pdf["host"], pdf["delay"]):
                time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                row = fetch_one(url, timeout, retries, backoff, robot)
                free[host] = time.monotonic() + (delay if pd.isna(own) else own)
                yield pd.DataFrame([row], columns=[c.split()[0] for c in FETCHED.split(", ")])

    own = F.col("delay") if "delay" in urls.columns else F.lit(None).cast("double")
    return urls.select("url", U.host(F.col("url")).alias("host"), own.alias("delay")).repartition("host").mapInPandas(get, FETCHED)


def stored(pages: DataFrame) -> Fetch:
    """Pages (url, html) of a table, found by normalised URL, in the place of the web."""
    known = pages.select(U.normalize_url(F.col("url")).alias("__key"), "html").dropDuplicates(["__key"])

    def get(urls: DataFrame) -> DataFrame:
        found = urls.select("url", U.normalize_url(F.col("url")).alias("__key")).join(known, "__key", "left")
        there = F.col("html").isNotNull()
        return found.select("url", F.when(there, 200).otherwise(404).alias("status"), F.when(there, "text/html").alias("content_type"), "html", F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp").alias("fetched_at"))

    return get


def good_pages(fetched: DataFrame) -> DataFrame:
    """Pages that came with status 200 as HTML."""
    return fetched.where("status = 200 AND html IS NOT NULL AND content_type IN ('text/html', 'application/xhtml+xml')")


def crawl_web(spark: SparkSession, seeds: list[str], fetch: Fetch, max_depth: int = MAX_DEPTH, max_pages: int = 1000, robots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, url, title, content, crawled_at, depth, html) and links (src, dst) between them, from ``seeds`` on.

    A level is one job. URLs that are alike when normalised are fetched once, of pages alike in text the first stays, ``robots``
    (see ``robots_table``) may forbid some, and the crawl ends with ``max_pages`` documents, the first by depth and URL.
    """
    level = spark.createDataFrame([(u,) for u in seeds], "url string")
    seen = docs = links = None
    count = 0
    for depth in range(max_depth + 1):
        fresh = level.withColumn("key", U.normalize_url(F.col("url"))).groupBy("key").agg(F.min("url").alias("url"))
        if seen is not None:
            fresh = fresh.join(seen, "key", "left_anti")
        if robots is not None:
            fresh = crawl.robots_filter(fresh, robots).where("allowed").select("key", "url")
        fresh = cut(fresh)
        if count >= max_pages or fresh.isEmpty():
            break
        seen = fresh.select("key") if seen is None else seen.unionByName(fresh.select("key"))
        pages = good_pages(fetch(fresh.select("url"))).withColumn("content", T.page_text(F.col("html"))).withColumn("hash", crawl.content_hash(F.col("content")))
        pages = pages.withColumn("nth", F.row_number().over(Window.partitionBy("hash").orderBy("url"))).where("nth = 1").drop("nth")
        if docs is not None:
            pages = pages.join(docs.select("hash"), "hash", "left_anti")
        pages = pages.orderBy("url").limit(max_pages - count).withColumns({"title": T.page_title(F.col("html")), "depth": F.lit(depth)})
        pages = cut(pages.select("url", "title", "content", F.col("fetched_at").alias("crawled_at"), "depth", "html", "hash"))
        to = pages.select("url", F.explode(U.page_links("html", "url")).alias("target"))
        count += pages.count()
        docs, links = (pages, to) if docs is None else (docs.unionByName(pages), links.unionByName(to))
        level = to.select(F.col("target").alias("url"))
    if docs is None:
        return spark.createDataFrame([], "doc_id bigint, url string, title string, content string, crawled_at timestamp, depth int, html string"), spark.createDataFrame([], "src bigint, dst bigint")
    numbered = cut(docs.withColumn("doc_id", (F.row_number().over(Window.orderBy("depth", "url")) - 1).cast("bigint")).drop("hash"))  # max_pages rows at most
    key = numbered.select("doc_id", U.normalize_url(F.col("url")).alias("key"))
    ends = links.select("url", U.normalize_url(F.col("target")).alias("key")).join(key, "key").select("url", F.col("doc_id").alias("dst"))
    return numbered, ends.join(numbered.select("url", F.col("doc_id").alias("src")), "url").select("src", "dst")
