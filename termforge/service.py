"""The engine over HTTP: GET /, /search, /stats, /health; POST /search, /index, /crawl; PUT /ranking/weights. JSON in and out."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from termforge.plans.engine import SearchEngine
from termforge.sources import web
from termforge.sources.store import DOCUMENT


class Service:
    """What each route does; ``handle`` gives a status and an answer."""

    def __init__(self, engine: SearchEngine, fetch: web.Fetch = web.fetch):
        self.engine, self.fetch, self.changing = engine, fetch, threading.Lock()

    def handle(self, method: str, target: str, body: dict[str, Any] | None = None) -> tuple[int, dict[str, Any]]:
        url = urlsplit(target)
        asked = {k: v[-1] for k, v in parse_qs(url.query).items()} | (body or {})
        route = self.routes().get((method, url.path.rstrip("/") or "/"))
        if route is None:
            return 404, {"error": f"no {method} {url.path}"}
        try:
            return 200, route(asked)
        except (ValueError, TypeError, KeyError) as e:
            return 400, {"error": str(e)}

    def routes(self) -> dict:
        return {
            ("GET", "/"): lambda _: {"message": "termforge", "routes": sorted({p for _, p in self.routes()})}, ("GET", "/search"): self.search, ("POST", "/search"): self.search,
            ("POST", "/index"): self.index, ("POST", "/crawl"): self.crawl, ("PUT", "/ranking/weights"): self.weights,
            ("GET", "/stats"): lambda _: self.engine.stats() | {"ranking": dict(zip(("alpha", "beta", "gamma"), self.engine.weights))}, ("GET", "/health"): lambda _: {"status": "healthy", "timestamp": time.time()},
        }

    def search(self, asked: dict) -> dict:
        return self.engine.search(str(asked.get("q", asked.get("query", ""))), int(asked.get("top_k", 10)), asked.get("clicked"), config=asked.get("config"))

    def index(self, asked: dict) -> dict:
        with self.changing:
            doc_id = int(asked.get("doc_id", time.time_ns() // 1000))
            self.engine.add(self.engine.spark.createDataFrame([(doc_id, asked["url"], asked.get("title"), asked["content"], None)], DOCUMENT))
        return {"status": "indexed", "doc_id": doc_id}

    def crawl(self, asked: dict) -> dict:
        with self.changing:
            docs, links = web.crawl_web(self.engine.spark, list(asked["seed_urls"]), self.fetch, max_pages=int(asked.get("max_pages", 50)))
            if found := docs.count():
                self.engine.add(docs.select("doc_id", "url", "title", "content", "crawled_at"), links)
        return {"status": "completed", "documents_crawled": found}

    def weights(self, asked: dict) -> dict:
        used = self.engine.set_weights(*(float(asked[n]) for n in ("alpha", "beta", "gamma")))
        return {"status": "updated", "weights": dict(zip(("alpha", "beta", "gamma"), used))}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't running yet: ``serve_forever`` starts it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size)) if size else None
                status, said = service.handle(self.command, self.path, body) if body is None or isinstance(body, dict) else (400, {"error": "the body must be an object"})
            except ValueError as e:
                status, said = 400, {"error": str(e)}
            data = json.dumps(said, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = answer  # noqa: N815

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
