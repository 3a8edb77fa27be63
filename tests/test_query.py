import random

import pytest
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import boolean, index, snippets, understanding
from termforge.plans import parser
from termforge.plans.cache import RedisBackend, ResultCache


def test_parsing():
    assert parser.parse("Python Search").terms == ["python", "search"] and parser.parse("  ").terms == []
    assert parser.parse('"exact phrase"').phrase == "exact phrase" and parser.parse('"a" b').kind == "keyword"
    tree = parser.parse("a AND b OR c NOT d")
    assert str(tree) == "(((a AND b) OR c) NOT d)" and tree.all_terms() == ["a", "b", "c", "d"]
    assert parser.parse("NOT x").kind == "keyword" and parser.parse("a and b").kind == "keyword"
    named = parser.parse("title:Engine rest")
    assert named.name == "title" and named.terms == ["Engine"]


@pytest.fixture(scope="module")
def stream(spark):
    docs = [(1, "search engine design"), (2, "engine search"), (3, "search engines and the search"), (4, "nothing"), (5, None)]
    return index.token_stream(spark.createDataFrame(docs, "doc_id bigint, text string")).cache()


@pytest.mark.parametrize("query,ids", [
    ("search AND design", {1}), ("design OR nothing", {1, 4}), ("search NOT design", {2, 3}), ('"search engine"', {1, 3}), ('"engine search"', {2, 3}), ("search", {1, 2, 3}), ("the", set()), ('"search engine design"', {1}),
])
def test_strict_evaluation(stream, query, ids):
    assert {r["doc_id"] for r in parser.evaluate(parser.parse(query), stream).collect()} == ids


def test_words_of_some_stems(spark):
    """All tokens of a vocabulary whose stem is asked for, and only those; no others are exploded."""
    words = ["run", "runs", "running", "runn", "nation", "nate", "nator", "cats", "cat", "cate", "cation", "studies", "study", "rung", "runner"]
    for stem in {T.stem_word(w) for w in words}:
        assert {w for w in words if T.stem_word(w) == stem} == set(T.unstemmed([stem])) & set(words)
    docs = spark.createDataFrame([(1, "running runs cats"), (2, "nothing of it"), (3, None), (4, "runn run")], "doc_id bigint, text string")
    tf, lengths = index.matched(docs, ["runn", "run"])
    assert sorted(map(tuple, tf.collect())) == [(1, "run", 1, 3), (1, "runn", 1, 3), (4, "run", 1, 2), (4, "runn", 1, 2)]
    assert sorted(map(tuple, lengths.collect())) == [(1, 3), (2, 1), (3, 0), (4, 2)]
    assert sorted(map(tuple, index.token_stream(docs, only=["run"]).collect())) == [(1, 1, "run"), (4, 1, "run")]
    assert parser.looked_for(parser.parse('"running cats" AND runs')) == ["runn", "cat", "run"]


def test_postings_of_shared_numbers(spark):
    """Rows that share a doc_id, or have none, are one document; documents alone aren't shuffled."""
    rows = [(1, "runs cats running"), (2, "cats"), (2, "dogs cats cats"), (None, "cats"), (None, "cats"), (3, None), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(((r["doc_id"] or 0, r["term"], r["tf"], r["positions"]) for r in index.postings(docs).collect()))
    assert found == [(0, "cat", 2, [0, 0]), (1, "cat", 1, [1]), (1, "run", 1, [0]), (1, "runn", 1, [2]), (2, "cat", 3, [0, 1, 2]), (2, "dog", 1, [0])]
    assert "hashpartitioning" not in index.postings(docs.where("doc_id IN (1, 3, 4)"))._jdf.queryExecution().executedPlan().toString()


def test_all_terms_at_once(stream):
    assert {r["doc_id"] for r in boolean.having_all(stream, ["search", "design", "design"]).collect()} == {1}


@pytest.mark.parametrize("query,kind", [("go to my bank", "navigational"), ("www.example.com", "navigational"), ("BUY shoes", "transactional"), ("how do trees grow", "informational"), ("", "informational")])
def test_intent(spark, query, kind):
    assert spark.createDataFrame([(query,)], "q string").select(understanding.intent(F.col("q"))).first()[0] == kind


def test_spelling(spark):
    words = spark.createDataFrame([(w,) for w in ("pyhton", "Serach", "engine", "zz", "qqqqqqqq", "engin")], "word string")
    vocabulary = spark.createDataFrame([(t,) for t in ("python", "search", "engine", "engines", "algorithm")], "term string")
    found = {r["word"]: (r["correction"], r["distance"]) for r in understanding.corrections(words, vocabulary).collect()}
    assert found == {"pyhton": ("python", 2), "serach": ("search", 2), "engin": ("engine", 1)}


def test_synonyms_and_their_twin(spark):
    for q in ("fix bug", "start", "launch patch", "quick", "unknown words"):
        words = q.split()
        assert spark.createDataFrame([(words,)], "w array<string>").select(understanding.expand(F.col("w"))).first()[0] == understanding.expand_words(words)
        assert set(words) <= set(understanding.expand_words(words))


def test_highlighting_and_its_twin(spark):
    text = "The Search engine searches; $1 (x)"
    for terms in (["search"], ["search", "arc"], ["(x)"], ["$1"], []):
        assert spark.createDataFrame([(text,)], "t string").select(snippets.highlight(F.col("t"), terms)).first()[0] == snippets.highlight_string(text, terms)
    assert snippets.highlight_string("Ab ab", ["AB"]) == "**Ab** **ab**"


def test_snippets():
    long = "filler words " * 60 + "needle in hay " + "more filler " * 60
    best = snippets.snippet_of(long, ["needle"])
    assert "**needle**" in best and best.startswith("...") and best.endswith("...") and len(best) < 230
    assert snippets.snippet_of("short", []) == "short" and snippets.snippet_of("x" * 300, []) == "x" * 200 + "..." and snippets.snippet_of(None, ["a"]) == ""
    several = snippets.snippets_of("needle " + "x " * 300 + "needle " + "y " * 300 + "needle", ["needle"], 100)
    assert len(several) == 3 and all("**needle**" in s for s in several) and snippets.snippets_of("abc", ["zz"]) == ["abc"]


def test_windows_hold_the_most_hits():
    text = "a" * 300 + " cat " + "b" * 300 + " cat dog cat " + "c" * 300
    begin, stop = snippets.best_window(text, ["cat", "dog"], 100)
    assert text[begin:stop].count("cat") == 2 and "dog" in text[begin:stop]


def test_cache():
    now = [0.0]
    cache = ResultCache(size=3, ttl=10, clock=lambda: now[0])
    for k in "abc":
        cache.put((k,), {"v": k})
    for _ in range(3):
        assert cache.get(("a",))["v"] == "a"
    cache.put(("d",), 1)  # b is the one not used for longest among the rare
    assert cache.get(("b",)) is None and cache.get(("a",)) and cache.get(("c",)) and cache.get(("d",)) == 1
    held = cache.get(("a",))
    held["v"] = "changed"
    assert cache.get(("a",))["v"] == "a"
    now[0] = 11
    assert cache.get(("a",)) is None
    cache.put(("x",), 1)
    cache.invalidate_all()
    assert cache.get(("x",)) is None and cache.version == 1 and 0 < cache.stats()["hit_rate"] < 1


def test_cache_behind_the_cache():
    """With any client that has get and set: another driver finds what the first one put."""
    held = {}
    client = type("Client", (), {"get": lambda self, k: held.get(k), "set": lambda self, k, v, px: held.__setitem__(k, v.encode())})()
    first, second = (ResultCache(backend=RedisBackend(client=client)) for _ in range(2))
    first.put(("q", 1), {"results": [1, 2]})
    assert second.get(("q", 1)) == {"results": [1, 2]} and second.get(("q", 2)) is None and second.stats()["hits"] == 1 and len(second) == 1


@pytest.mark.parametrize("few", [True, False])
def test_either_way_finds_the_nearest_terms(spark, few):
    """Against all pairs: comparing with every term, and meeting by what is left after deletions."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    terms, words = sorted({word() for _ in range(120)}), sorted({word() for _ in range(60)} | {"", "aé", "x" * 60})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    best = {w: min((distance(w, t), t) for t in terms) for w in words}
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    found = understanding.nearest_terms(frame(words, "word"), frame(terms, "term"), few=few).collect()
    assert {r["word"]: (r["distance"], r["correction"]) for r in found} == {w: b for w, b in best.items() if b[0] <= 2}


def test_forms_of_many_words_are_not_broadcast(spark):
    """Spark takes what is exploded for no larger than before."""
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    near = understanding._sharing(frame(["serch"], "word"), frame(["search"], "term"), 1)
    assert "SortMergeJoin" in (plan := near._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan


def test_queries_that_come_twice(spark):
    """Rows that are equal are one query, whose words count once; other texts of the same number are queries of their own."""
    rows = [(1, "serch it"), (1, "serch it"), (1, "fix"), (None, "serch")]
    found = understanding.process(spark.createDataFrame(rows, "query_id int, text string"), spark.createDataFrame([("search",)], "term string")).collect()
    assert sorted((r["query_id"] or 0, r["original"], r["rewritten"]) for r in found) == [(0, "serch", "search"), (1, "fix", "fix"), (1, "serch it", "search it")]


def test_a_table_of_queries_is_understood_at_once(spark):
    rows = [(1, "Buy serch engne"), (2, "fix the error"), (3, None), (4, "  "), (5, "go to serch")]
    vocabulary = spark.createDataFrame([(t,) for t in ("search", "engine", "buy", "fix", "the", "error")], "term string")
    found = {r["query_id"]: r for r in understanding.process(spark.createDataFrame(rows, "query_id int, text string"), vocabulary).collect()}
    assert found[1]["rewritten"] == "buy search engine" and found[1]["intent"] == "transactional" and found[5]["intent"] == "navigational"
    assert {"bug", "issue", "repair"} <= set(found[2]["expanded"]) and found[3]["rewritten"] == "" == found[4]["rewritten"] and len(found) == 5
    assert all(understanding.intent_of(q or "") == found[k]["intent"] for k, q in rows)


def test_fields_are_looked_for_in_their_columns(spark):
    meta = spark.createDataFrame([(1, "Spark tools", "http://a.example/x"), (2, "Other", "http://spark.example/y"), (3, None, None)], "doc_id bigint, title string, url string")
    stream = index.token_stream(spark.createDataFrame([(k, "spark text") for k in (1, 2, 3)], "doc_id bigint, text string"))
    found = lambda q: {r["doc_id"] for r in parser.evaluate(parser.parse(q), stream, meta).collect()}
    assert found("title:Spark") == {1} and found("url:spark") == {2} and found("spark") == {1, 2, 3} and found("title:spark OR url:spark") == {1, 2} and found("author:spark") == {1, 2, 3}
