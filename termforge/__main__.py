"""python -m termforge COMMAND: crawl, index, search, demo, stats, bench, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from termforge import samples
from termforge.plans.engine import SearchEngine
from termforge.service import Service, serve
from termforge.sources import exchange, web


def _parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="termforge", description=__doc__)
    whole.add_argument("--data-dir", default="./data")
    commands = whole.add_subparsers(dest="command", required=True)
    add = lambda name, text: commands.add_parser(name, help=text)
    crawl = add("crawl", "crawl from seed URLs and keep the pages")
    crawl.add_argument("seeds", nargs="+")
    crawl.add_argument("--max-pages", type=int, default=50)
    crawl.add_argument("--max-depth", type=int, default=3)
    index = add("index", "index what was crawled, or a Parquet table of documents")
    index.add_argument("--documents", help="doc_id, url, title, content, crawled_at")
    search = add("search", "ask the index")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=10)
    search.add_argument("--json", action="store_true")
    add("demo", "index the sample documents and ask some queries")
    add("stats", "what the index holds")
    add("bench", "time searches over the index").add_argument("--rounds", type=int, default=5)
    service = add("serve", "answer over HTTP")
    service.add_argument("--host", default="127.0.0.1")
    service.add_argument("--port", type=int, default=8000)
    return whole


def show(found: dict) -> None:
    info = found["query_info"]
    if info["corrections"]:
        print(f"  read as: {info['rewritten']}")
    for k, r in enumerate(found["results"], 1):
        print(f"{k:3}. {r['title'] or r['url']}  ({r['score']:.4f})\n     {r['url']}\n     {r['snippet']}")
    print(f"  {found['total_results']} results in {found['timing']['total_ms']} ms, {info['intent']}")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("termforge").getOrCreate()
    folder = asked.data_dir.rstrip("/")
    engine = SearchEngine(spark, f"{folder}/index")
    if asked.command == "crawl":
        docs, links = web.crawl_web(spark, asked.seeds, web.fetch, asked.max_depth, asked.max_pages)
        docs.write.mode("overwrite").parquet(f"{folder}/crawl/documents")
        links.write.mode("overwrite").parquet(f"{folder}/crawl/links")
        exchange.write_crawl(docs, links, f"{folder}/crawl/results")
        print(f"{docs.count()} documents crawled")
    elif asked.command == "index":
        docs = spark.read.parquet(asked.documents or f"{folder}/crawl/documents").select("doc_id", "url", "title", "content", "crawled_at")
        engine.add(docs, None if asked.documents else spark.read.parquet(f"{folder}/crawl/links"))
        print(f"{engine.stats()['documents']} documents in the index")
    elif asked.command == "search":
        found = engine.search(asked.query, asked.top_k)
        print(json.dumps(found, default=str)) if asked.json else show(found)
    elif asked.command == "demo":
        engine.add(samples.documents(spark), samples.links(spark))
        for q in samples.QUERIES:
            print(f"\n{q}")
            show(engine.search(q, 3))
    elif asked.command == "stats":
        print(json.dumps(engine.stats(), indent=1))
    elif asked.command == "bench":
        times = sorted(engine.search(q, use_cache=False)["timing"]["total_ms"] for _ in range(asked.rounds) for q in samples.QUERIES)
        print(json.dumps({"searches": len(times), "p50_ms": times[len(times) // 2], "p95_ms": times[int(len(times) * 0.95)]}))
    else:
        server = serve(Service(engine), asked.host, asked.port)
        print(f"http://{asked.host}:{asked.port}")
        server.serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
