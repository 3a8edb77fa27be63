"""The web source, crawls, the command line and the HTTP service, on a small server of the tests' own."""

import json
import threading
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from termforge import samples
from termforge.__main__ import main
from termforge.operators import crawl
from termforge.plans.engine import SearchEngine
from termforge.service import Service, serve
from termforge.sources import exchange, web

PAGES = {
    "/": ("text/html", "<title>Home &eacute;</title><a href='a.html'>a</a> <a href=b.html>b</a> <a href='/gone'>x</a> <a href='/private/p'>p</a>"),
    "/a.html": ("text/html", "<title>A</title>first page <a href='c.html#top'>c</a> <a href='/'>home</a>"), "/b.html": ("text/html", "<title>B</title>first   page c home"),
    "/c.html": ("text/html; charset=latin-1", "<title>C</title>third page <a href='data.bin'>d</a>"), "/data.bin": ("application/octet-stream", "x"), "/private/p": ("text/html", "hidden"),
}


@pytest.fixture(scope="module")
def site():
    tries = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            tries[self.path] = tries.get(self.path, 0) + 1
            busy = self.path == "/a.html" and tries[self.path] == 1
            kind, text = PAGES.get(self.path, (None, ""))
            self.send_response(503 if busy else 200 if kind else 404)
            self.send_header("Content-Type", kind or "text/plain")
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", tries
    server.shutdown()


def get(urls):
    return web.fetch(urls, delay=0.0, backoff=0.01)


def test_what_may_pass_is_tried_again(spark, site):
    root, _ = site
    waits = []
    assert web.fetch_one(f"{root}/a.html", 5, 2, 0.5, "t", waits.append)[1:3] == (200, "text/html") and waits == [0.5]
    assert web.fetch_one(f"{root}/gone", 5, 2, 0.5, "t", waits.append)[1:5] == (404, None, None, 1) and waits == [0.5]
    none = web.fetch_one("http://127.0.0.1:9/", 1, 2, 0.5, "t", waits.append)
    assert none[1] is None and none[4] == 3 and none[5] and waits == [0.5, 0.5, 1.0]
    assert web.fetch_one("no url", 1, 2, 0.5, "t", waits.append)[4] == 1


def test_a_crawl(spark, site, tmp_path):
    root, tries = site
    rules = crawl.robots_table(spark.createDataFrame([(root.split("//")[1], "User-agent: *\nDisallow: /private")], "host string, content string"))
    docs, links = web.crawl_web(spark, [f"{root}/", f"{root}"], get, robots=rules)
    found = {r["url"].removeprefix(root) or "/": r for r in docs.collect()}
    assert {u: r["depth"] for u, r in found.items()} == {"/": 0, "/a.html": 1, "/c.html": 2} or {u: r["depth"] for u, r in found.items()} == {"/": 0, "/b.html": 1, "/a.html": 1, "/c.html": 2}
    assert found["/"]["title"] == "Home é" and "/private/p" not in tries and sorted(r["doc_id"] for r in found.values()) == list(range(len(found)))
    ids = {u: r["doc_id"] for u, r in found.items()}
    assert {(ids["/"], ids["/a.html"]), (ids["/a.html"], ids["/c.html"]), (ids["/a.html"], ids["/"])} <= {tuple(r) for r in links.collect()}
    assert web.crawl_web(spark, [f"{root}/"], get, max_pages=2)[0].count() == 2 and web.crawl_web(spark, [f"{root}/gone"], get)[0].count() == 0
    exchange.write_crawl(docs, links, str(tmp_path / "results"))
    urls, again = exchange.read_crawl(spark, str(tmp_path / "results"))
    assert sorted(map(tuple, urls.collect())) == sorted((r["doc_id"], r["url"]) for r in found.values()) and sorted(map(tuple, again.collect())) == sorted(map(tuple, links.collect()))
    pages = spark.createDataFrame([(f"{root}{p}", t) for p, (_, t) in PAGES.items()], "url string, html string")
    assert web.crawl_web(spark, [f"{root}/"], web.stored(pages), max_depth=1)[0].where("depth = 1").count() >= 2


def test_commands(spark, tmp_path, capsys):
    data = ["--data-dir", str(tmp_path)]
    assert main([*data, "demo"], spark) == 0
    said = capsys.readouterr().out
    assert "Search engines" in said and "read as: riv flood" in said
    assert main([*data, "search", "honey", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["title"] == "Keeping bees"
    assert main([*data, "stats"], spark) == 0 and json.loads(capsys.readouterr().out)["documents"] == 6
    samples.documents(spark).write.parquet(str(tmp_path / "more"))
    assert main([*data, "index", "--documents", str(tmp_path / "more")], spark) == 0 and "6 documents" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([*data, "fly"], spark)


def test_routes(spark, tmp_path, site):
    root, _ = site
    engine = SearchEngine(spark, str(tmp_path / "index"))
    server = serve(Service(engine, get), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                return answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert ask("GET", "/health")[1]["status"] == "healthy" and "/search" in ask("GET", "/")[1]["routes"] and ask("GET", "/nothing")[0] == 404
    assert ask("POST", "/crawl", {"seed_urls": [f"{root}/"], "max_pages": 3})[1]["documents_crawled"] == 3
    assert ask("POST", "/index", {"url": "u", "title": "t", "content": "entirely new words"})[1]["status"] == "indexed"
    assert ask("GET", "/search?q=entirely&top_k=1")[1]["results"][0]["url"] == "u" and ask("POST", "/search", {"query": "page"})[1]["total_results"] > 0
    assert ask("PUT", "/ranking/weights", {"alpha": 2, "beta": 1, "gamma": 1})[1]["weights"] == {"alpha": 0.5, "beta": 0.25, "gamma": 0.25}
    assert {ask(*a)[0] for a in (("GET", "/search?q="), ("GET", "/search?q=x&top_k=101"), ("PUT", "/ranking/weights", {"alpha": 0, "beta": 0, "gamma": 0}), ("POST", "/index", {}), ("POST", "/search", [1]))} == {400}
    assert ask("GET", "/stats")[1]["documents"] == 4
    server.shutdown()
