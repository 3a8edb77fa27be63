"""Files that are exchanged with others: crawl results, result lists, cached embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRAWL = "total_documents bigint, urls array<string>, link_graph map<string,array<bigint>>, url_to_doc_id map<string,bigint>"


def read_crawl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, url) and (src, dst) of a crawl result file."""
    whole = spark.read.schema(CRAWL).json(path, multiLine=True)
    urls = whole.select(F.explode("url_to_doc_id").alias("url", "doc_id")).select("doc_id", "url")
    links = whole.select(F.explode("link_graph").alias("src", "to")).select(F.col("src").cast("bigint"), F.explode("to").alias("dst"))
    return urls, links


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of files named ``<doc_id>.txt``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    return files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.txt$", 1).cast("bigint").alias("doc_id"), F.col("value").alias("content"))


def write_results(results: DataFrame, path: str, form: str = "csv") -> None:
    """A result list for download, as CSV with a header or JSON lines."""
    if form not in ("csv", "json"):
        raise ValueError(f"unknown form: {form}")
    writer = results.coalesce(1).write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.json(path)


def with_cached_embeddings(docs: DataFrame, cache: DataFrame, encode, text_col: str = "text") -> DataFrame:
    """(key, embedding) of all texts: known ones from ``cache``, each new text encoded once. ``encode`` maps (doc_id, text)."""
    keyed = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    fresh = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    encoded = encode(fresh.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "embedding")
    return cache.join(keyed.select("key").distinct(), "key", "left_semi").select("key", "embedding").unionByName(encoded)


def write_crawl(docs: DataFrame, links: DataFrame, path: str) -> None:
    """A crawl result file, as ``read_crawl`` takes it, from (doc_id, url) and (src, dst): one JSON document, for crawls that fit in one."""
    known = docs.agg(F.count("*").alias("total_documents"), F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "url"))), lambda d: d["url"]).alias("urls"), F.map_from_entries(F.collect_list(F.struct("url", "doc_id"))).alias("url_to_doc_id"))
    graph = links.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("src").cast("string"), "to"))).alias("link_graph"))
    known.crossJoin(graph).select("total_documents", "urls", "link_graph", "url_to_doc_id").coalesce(1).write.mode("overwrite").json(path)


def write_pages(docs: DataFrame, path: str) -> None:
    """The documents' texts in parts by doc_id, instead of a file for each: (doc_id, content) as Parquet."""
    docs.select("doc_id", "content").write.mode("overwrite").parquet(path)
