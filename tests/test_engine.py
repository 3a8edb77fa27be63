"""The store, the engine, crawling, streams and exchange files, from end to end."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import crawl, index
from termforge.plans.engine import SearchEngine
from termforge.sources import exchange
from termforge.sources.store import DOCUMENT, IndexStore, upsert
from termforge.streaming import ingest

DOCS = [
    (0, "http://a.example/0", "Languages", "python is a programming language for search tools and python scripts", None),
    (1, "http://a.example/1", "Engines", "a search engine ranks documents with an inverted index", None),
    (2, "http://a.example/2", "Learning", "machine learning models learn from data", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, DOCUMENT)


@pytest.fixture(scope="module")
def engine(spark, docs, tmp_path_factory):
    engine = SearchEngine(spark, str(tmp_path_factory.mktemp("engine")))
    engine.add(docs, spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0)], "src bigint, dst bigint"))
    return engine


def df_of(store):
    return {r["term"]: r["df"] for r in index.doc_frequency(store.postings()).collect()}


def test_segments_deletes_and_merges(spark, docs, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.postings().count() == 0 and store.segment_ids() == []
    assert [store.add(docs.where("doc_id < 2")), store.add(docs.where("doc_id = 2"))] == [0, 1]
    assert df_of(store)["search"] == 2 and index.corpus_stats(store.lengths()).first()["n_docs"] == 3
    store.delete(spark.createDataFrame([(0,), (77,)], "doc_id bigint"))
    assert df_of(store)["search"] == 1 and "python" not in df_of(store)
    before = df_of(store)
    assert store.merge_smallest() == 2 and store.segment_ids() == [2] and df_of(store) == before
    store.add(docs.where("doc_id = 0"))  # comes back
    store.add(docs.where("doc_id = 1").withColumn("content", F.lit("other words")))  # replaces itself
    again = df_of(store)
    assert again["python"] == 1 and again["search"] == 1 and again["word"] == 1 and store.lengths().count() == 3
    assert store.merge_if_needed(99) is None and store.merge_if_needed(3) is not None and df_of(store) == again
    assert {r["num_docs"] for r in store.segments().collect()} <= {1, 2, 3}


def test_lookup_reaches_the_files(spark, docs, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.add(docs)
    found = store.lookup(["search"])
    assert found.count() == 2
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("\n")[0]


def test_search(engine):
    found = engine.search("python programming")
    assert found["results"][0]["doc_id"] == 0 and "**python**" in found["results"][0]["snippet"] and found["total_results"] == len(found["results"])
    scores = [r["score"] for r in found["results"]]
    assert scores == sorted(scores, reverse=True) and not found["from_cache"] and engine.search("python programming")["from_cache"]
    assert engine.search("xyzzyqwv")["results"] == []
    assert engine.search("serch")["query_info"]["corrections"] == {"serch": "search"}


def test_search_checks_its_arguments(engine):
    for bad in ({"query": " "}, {"query": "x", "k": 0}, {"query": "x", "k": 101}):
        with pytest.raises(ValueError):
            engine.search(**bad)


def test_weights_history_and_stats(engine):
    plain = {r["doc_id"]: r["score"] for r in engine.search("search", weights=(1.0, 0.0, 0.0))["results"]}
    clicked = {r["doc_id"]: r["score"] for r in engine.search("search", clicked=[1], weights=(1.0, 0.0, 0.0))["results"]}
    assert clicked[1] == pytest.approx(plain[1] + 0.05) and clicked[0] == plain[0]
    assert engine.set_weights(1, 1, 2) == (0.25, 0.25, 0.5)
    stats = engine.stats()
    assert stats["documents"] == 3 and stats["segments"] == 1 and stats["terms"] > 10


def test_strict_and_batch(spark, engine):
    assert {r["doc_id"] for r in engine.search_strict('"search engine"').collect()} == {1}
    queries = spark.createDataFrame([(5, "python"), (6, "data models"), (7, None)], "query_id bigint, text string")
    assert {(r["query_id"], r["doc_id"]) for r in engine.search_batch(queries).where("rank = 1").collect()} == {(5, 0), (6, 2)}


def test_incremental_documents(spark, docs, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "e"))
    engine.add(docs)
    assert engine.search("quantum")["results"] == []
    engine.add(spark.createDataFrame([(99, "u", "t", "quantum computing", None)], DOCUMENT))
    assert [r["doc_id"] for r in engine.search("quantum")["results"]] == [99]
    engine.delete(99)
    assert engine.search("quantum")["results"] == []


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "doc_id bigint, url string, v int")
    new = spark.createDataFrame([(1, "x", 2), (9, "b", 2)], "doc_id bigint, url string, v int")
    assert sorted(map(tuple, upsert(old, new).collect())) == [(1, "x", 2), (3, "c", 1), (9, "b", 2)]


def test_robots(spark):
    rules = crawl.parse_robots("# c\nUser-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: x\nCrawl-delay: 2.5\nDisallow:\n")
    assert rules.allows("/") and not rules.allows("/private/x") and rules.allows("/private/open/y") and rules.delay == 2.5
    assert crawl.parse_robots(None).allows("/x") and not crawl.parse_robots("User-agent: TermForge\nDisallow: /x").allows("/x")
    urls = spark.createDataFrame([("http://a.example/private",), ("http://b.example/private",)], "url string")
    files = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private")], "host string, content string")
    assert {r["url"]: r["allowed"] for r in crawl.robots_filter(urls, crawl.robots_table(files)).collect()} == {"http://a.example/private": False, "http://b.example/private": True}


def test_frontier_and_crawl(spark):
    frontier = spark.createDataFrame([("http://a.example/1", 0.5, 0), ("http://a.example/2", 0.9, 1), ("http://b.example/1", 0.1, 3), ("http://b.example/2", 1.0, 4)], "url string, priority double, depth int")
    assert {r["url"]: r["slot"] for r in crawl.schedule(frontier).collect()} == {"http://a.example/2": 1, "http://a.example/1": 2, "http://b.example/1": 1}
    pages = spark.createDataFrame([(k,) for k in range(8)], "page_id bigint")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (0, 99)], "src bigint, dst bigint")
    assert {r["page_id"]: r["depth"] for r in crawl.crawl(pages, pages.where("page_id = 0"), links).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_dedup(spark):
    docs = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c"), (4, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["copies"]) for r in crawl.dedup_content(docs).collect()) == [(1, 2), (3, 1), (4, 1)]


def test_stream_into_segments(spark, docs, tmp_path):
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    seen = []
    store = IndexStore(spark, str(tmp_path / "index"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(ingest.read_files(spark, str(tmp_path / "in"), docs.schema), store, str(tmp_path / "state"), lambda b: seen.append(b.count()))
    assert sum(seen) == 3 and df_of(store)["search"] == 2


def test_streams_with_state(spark, tmp_path):
    spark.createDataFrame([("http://a.example/x/", 0), ("http://A.example/x", 5), ("http://b.example/", 3), ("http://a.example/y", 6)], "url string, at_ms bigint").write.parquet(str(tmp_path / "in"))
    stream = lambda: ingest.read_files(spark, str(tmp_path / "in"), "url string, at_ms bigint")
    for name, df in (("unseen", ingest.unseen_urls(stream())), ("polite", ingest.polite(stream(), 1000))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("unseen").count() == 3
    times = sorted(r["fetch_at"] for r in spark.table("polite").where("lower(host) = 'a.example'").collect())
    assert spark.table("polite").count() == 4 and len(times) == 3


def test_exchange(spark, tmp_path):
    result = {"total_documents": 2, "urls": ["u", "v"], "link_graph": {"0": [1, 1]}, "url_to_doc_id": {"u": 0, "v": 1}}
    (tmp_path / "crawl.json").write_text(json.dumps(result, indent=1))
    urls, links = exchange.read_crawl(spark, str(tmp_path / "crawl.json"))
    assert sorted(map(tuple, urls.collect())) == [(0, "u"), (1, "v")] and [tuple(r) for r in links.collect()] == [(0, 1), (0, 1)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/7.txt").write_text("two\nlines")
    assert [tuple(r) for r in exchange.read_page_texts(spark, str(tmp_path / "pages")).collect()] == [(7, "two\nlines")]
    for form in ("csv", "json"):
        exchange.write_results(urls, str(tmp_path / form), form)
        assert spark.read.format(form).load(str(tmp_path / form), header=True).count() == 2
    with pytest.raises(ValueError):
        exchange.write_results(urls, str(tmp_path / "x"), "xml")


def test_crawl_over_the_whole_graph(spark, sf_dir):
    """By brute force: all that is reached over all edges, not an id subset."""
    from termforge.plans import catalog

    edges = {(r["src"], r["dst"]) for r in catalog.trade(spark, sf_dir).collect()}
    seeds = {r["s"] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg({"c_custkey": "min"}).toDF("n", "s").collect()}
    expected = {n: 0 for n in seeds & {n for e in edges for n in e}}
    for depth in (1, 2, 3):
        expected |= {b: depth for b in {b for a, b in edges if a in expected} - set(expected)}
    found = {r["page_id"]: r["depth"] for r in catalog.QUERIES["crawl_trade"](spark, sf_dir).collect()}
    assert found == expected and len(found) > 15


def test_an_engine_goes_on_where_another_one_stopped(spark, docs, engine):
    again = SearchEngine(spark, engine.store.path, engine.weights)
    for q in ("python programming", "serch engine", "learning data"):
        one, two = (e.search(q, use_cache=False) for e in (engine, again))
        assert [r | {"snippet": ""} for r in one["results"]] == [r | {"snippet": ""} for r in two["results"]] and one["results"]
    weights = {"alpha": 0.2, "beta": 0.3, "gamma": 0.5}
    found = again.search("search", config=weights | {"k1": 2.0})
    assert found["config_used"] == weights | {"k1": 2.0, "b": 0.75, "click_boost": 0.05} and any(r["scores"]["pagerank"] > 0 for r in found["results"])
    assert {r["scores"]["semantic"] for r in found["results"]} != {0.0}
    with pytest.raises(ValueError):
        again.search("search", config={"delta": 1.0})


class Letters:
    """An encoder of the engine's user."""

    def table(self, docs):
        return docs.select("doc_id", F.array(*[F.size(F.split("text", c)).cast("double") for c in "aem"]).alias("embedding"))

    def vector(self, text):
        return [float(text.count(c) + 1) for c in "aem"]


def test_another_encoder(spark, docs, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "e"), encoder=Letters())
    engine.add(docs)
    assert engine.store.vectors().first()["embedding"].__len__() == 3
    assert [r["doc_id"] for r in engine.search("learning search", weights=(0.0, 0.0, 1.0))["results"]]


def test_a_write_that_ends_halfway_changes_nothing(spark, docs, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.add(docs)
    before, lengths = df_of(store), sorted(map(tuple, store.lengths().collect()))
    changed = docs.withColumn("content", F.lit("entirely different"))
    for step in ("_write", "_publish"):
        real = getattr(store, step)

        def broken(*args, **more):
            if step == "_write":
                real(*args, **more)
            raise OSError("the disk is full")

        monkeypatch.setattr(store, step, broken)
        for change in (lambda: store.add(changed), lambda: store._merge([0])):
            with pytest.raises(OSError):
                change()
        monkeypatch.undo()
        other = IndexStore(spark, store.path)
        assert df_of(other) == before and sorted(map(tuple, other.lengths().collect())) == lengths and other.segment_ids() == [0]
    store.add(changed)
    assert df_of(IndexStore(spark, store.path)) == {T.stem_word("entirely"): 3, T.stem_word("different"): 3}
    store.sweep()
    assert "python" not in df_of(store) and store.lengths().count() == 3
    (tmp_path / "index/manifest/99.json").write_text("{broken")
    assert IndexStore(spark, store.path).lengths().count() == 3


def test_writers_do_not_overwrite_each_other(spark, docs, tmp_path):
    one, two = (IndexStore(spark, str(tmp_path / "index")) for _ in range(2))
    state = one.manifest()
    two.add(docs)
    with pytest.raises(RuntimeError):
        one._publish(state, segments=[])
    assert one.lengths().count() == 3


def test_segments_of_a_size(spark, tmp_path):
    """More documents than a segment holds make several, each full but the last."""
    store = IndexStore(spark, str(tmp_path / "index"), segment_docs=2)
    rows = [(k, f"u{k}", None, f"word{k} common", None) for k in range(5)] + [(None, "u", None, "nobody", None), (3, "u3", None, "later common", datetime(2024, 1, 1))]
    assert store.add(spark.createDataFrame(rows, DOCUMENT)) == 2
    assert sorted(r["num_docs"] for r in store.segments().collect()) == [1, 2, 2] and df_of(store)["common"] == 5
    assert df_of(store)[T.stem_word("later")] == 1 and "word3" not in df_of(store) and "nobody" not in df_of(store)
    assert store.add(spark.createDataFrame([], DOCUMENT)) is None and store.segment_ids() == [0, 1, 2]
    assert {(r["term"], r["df"]) for r in store.terms().where("term = 'common'").groupBy("term").agg(F.sum("df").alias("df")).collect()} == {("common", 5)}


def test_what_is_written_between_is_cleared(spark):
    from termforge.sources import shared

    one, two = (shared.cut(spark.range(n)) for n in (3, 4))
    assert one.count() == 3 and two.count() == 4 and shared.clear(spark) >= 2 and not shared._made
    with pytest.raises(Exception, match="."):
        one.count()


def test_robots_files_grow_old(spark):
    rows = [("a", "old", datetime(2024, 1, 1, 10)), ("a", "new", datetime(2024, 1, 1, 12)), ("b", "stale", datetime(2024, 1, 1, 9)), ("c", "never", None)]
    fresh, again = crawl.fresh_robots(spark.createDataFrame(rows, "host string, content string, fetched_at timestamp"), datetime(2024, 1, 1, 12, 30))
    assert [(r["host"], r["content"]) for r in fresh.collect()] == [("a", "new")] and {r["host"] for r in again.collect()} == {"b", "c"}


def test_hosts_have_delays_of_their_own(spark, tmp_path):
    spark.createDataFrame([("http://a.example/1", 0, 10), ("http://a.example/2", 1, 10), ("http://b.example/1", 0, None), ("http://b.example/2", 1, None)], "url string, at_ms bigint, delay_ms bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_files(spark, str(tmp_path / "in"), "url string, at_ms bigint, delay_ms bigint")
    ingest.polite(stream, 1000).writeStream.format("memory").queryName("own").outputMode("append").option("checkpointLocation", str(tmp_path / "own")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["url"], r["fetch_at"]) for r in spark.table("own").collect()} == {("http://a.example/1", 0), ("http://a.example/2", 10), ("http://b.example/1", 0), ("http://b.example/2", 1000)}


def test_messages_are_read_as_they_were_written(spark):
    sent = spark.createDataFrame([(1, "a \"b\"", None), (2, None, 2.5)], "k bigint, t string, x double")
    assert sorted(map(tuple, ingest.from_json(ingest.as_json(sent), "k bigint, t string, x double").collect())) == sorted(map(tuple, sent.collect()))
