import sys
from html.entities import html5

import duckdb
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termforge.functions import codec
from termforge.functions import text as T
from termforge.functions import urls as U
from termforge.operators import index
from termforge.plans import catalog
from verify import spark_rows


def one(spark, column, *values, schema="x string"):
    return spark.createDataFrame([tuple(values)], schema).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [
    ("<div><p>Hello <b>World</b></p></div>", "hello world"), ("see https://a.example/b?c now", "see now"), ("www.a.example x", "x"), ("UPPER", "upper"), ("café résumé", "cafe resume"),
    ("&lt;b&gt;bold&lt;/b&gt; &amp; more", "bold more"), ("it's a_b", "it s a b"), ("re-use", "re-use"), ("", ""), (None, ""),
])
def test_normalize_and_its_twin(spark, raw, expected):
    assert one(spark, T.normalize(F.col("x")), raw) == expected == T.normalize_string(raw)


def test_twins_over_all_of_unicode(spark):
    """Every code point, between letters and alone, and every entity; the query's words must be those of the index."""
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts += [f"x&{name}y https://z.example/&{name} q" for name in html5] + [f"&#{n};&#x{n:x};&#{n}" for n in range(0x3000)]
    found = spark.createDataFrame(pd.DataFrame({"x": texts})).repartition(4).select("x", T.normalize(F.col("x")).alias("y")).toPandas()
    wrong = [(x, y, T.normalize_string(x)) for x, y in zip(found["x"], found["y"]) if y != T.normalize_string(x)]
    assert len(found) == len(texts) and not wrong, wrong[:20]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("aé &;#x3<>/-wW.\u00a0\ufb01\u0301htps:ampltcoy", max_size=40), min_size=300, max_size=400))
def test_twins_on_any_text(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    found = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.normalize(F.col("x")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in found] == [(t, T.normalize_string(t)) for t in texts]


def test_toggles(spark):
    assert one(spark, T.normalize(F.col("x"), strip_html=False, strip_urls=False), "<b> http://a.b") == "b http a b"
    assert one(spark, T.decompose(F.col("x")), "ﬁé") == "fie" and one(spark, T.unescape_all(F.col("x")), "&eacute;&#65;") == "éA"


def test_page_title_and_text(spark):
    page = "<html><head><TITLE lang=en> A &amp; B </title><style>p {}</style></head><body><script>var x;</script><p>Héllo https://a.example</p></body>"
    assert one(spark, T.page_title(F.col("x")), page) == "A & B" and one(spark, T.page_title(F.col("x")), "<p>") == "" == one(spark, T.page_title(F.col("x")), None)
    assert one(spark, T.page_text(F.col("x")), page) == "A & B Héllo https://a.example"


def test_entities_of_page_queries_are_those_of_sql(spark, tmp_path):
    """A title that ends within an entity, names of HTML 5, numbers, ampersands of any kind."""
    ends = ["&quot", "&quot;", "&amp", "&amp;", "&amp;quot;", "&ampquot;", "&eacute", "&eacute;x", "&#39;", "&#39", "&#65;", "&apos;", "&copy2", "&alpha;&thetasym;", "&lbrace;", "& amp;", "&&lt;", "&lt;i&gt;"]
    pages = [(k, "http://a.example", f"<title>token = {end}</title><p>cut {end}") for k, end in enumerate(ends)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("page_title", "page_text"):
        names, rows = spark_rows(catalog.QUERIES[name](spark, str(tmp_path)))
        db = duckdb.connect()
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert len(rows) == len(ends) and set(rows) == {tuple(dict(zip((c[0] for c in found.description), r))[n] for n in names) for found in [db.execute(catalog.ORACLES[name])] for r in found.fetchall()}


@pytest.mark.parametrize("word,stem", [("running", "runn"), ("class", "clas"), ("boxes", "boxe"), ("nation", "nate"), ("cats", "cat"), ("go", "go"), ("be", "be"), ("studies", "study"), ("happily", "happi")])
def test_stems(spark, word, stem):
    assert T.stem_word(word) == stem == one(spark, T.stem(F.col("x")), word)


def test_tokens(spark):
    text = "The quick brown fox is a well-known fox, " + "x" * 41 + " y"
    assert one(spark, T.terms(T.normalize(F.col("x"))), text) == ["quick", "brown", "fox", "well-known", "fox"] == T.terms_of(text)
    offsets = one(spark, T.tokens_with_offsets(T.normalize(F.col("x"))), "The search of Searches")
    assert [tuple(o) for o in offsets] == [("search", 0, 4, 10), ("searche", 1, 14, 22)]
    assert "the" in one(spark, T.tokens(F.col("x"), remove_stopwords=False), "the end")


def test_offsets_of_long_texts_leave_in_parts(spark):
    """As of each text by itself, with a text of more tokens than leave at once, one without and a row without doc_id."""
    docs = [(1, "the search & searches " * (index.ROWS_OUT // 2 + 7)), (2, None), (None, "Engine"), (1 << 60, "re-use it"), (5, " the ")]
    found = [tuple(r) for r in index.token_offsets(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)).collect()]
    expected = [(k, *t) for k, text in docs for t in T.offsets_of(T.normalize_string(text))]
    assert len(found) > index.ROWS_OUT and sorted(found, key=str) == sorted(expected, key=str)


@given(st.lists(st.integers(0, 1 << 62), max_size=30))
def test_variable_bytes_round_trip(numbers):
    assert codec.decode(codec.encode(numbers)) == numbers


def test_running_sums_of_gaps(spark):
    for numbers in ([], [0], [3, 5, 900], list(range(0, 40_000, 2))):
        assert one(spark, codec.sums(codec.gaps(F.col("x"))), numbers, schema="x array<int>") == numbers


def test_variable_bytes(spark):
    for n in (0, 1, 127, 128, 255, 1000, 16383, 16384, 100_000, 1 << 62):
        assert len(codec.encode([n])) == one(spark, codec.vbyte_size(F.col("x")), n, schema="x bigint")
    with pytest.raises(ValueError):
        codec.encode([-1])
    with pytest.raises(ValueError):
        codec.decode(codec.encode([300])[:1])
    assert one(spark, codec.vbyte_decode(codec.vbyte_encode(F.col("x"))), [10, 200, 3000, 40000], schema="x array<bigint>") == [10, 200, 3000, 40000]
    assert one(spark, codec.gaps(F.col("x")), [3, 5, 10], schema="x array<int>") == [3, 2, 5]


@pytest.mark.parametrize("url,expected", [
    ("http://A.example/x///", "http://a.example/x"), ("http://a.example/#top", "http://a.example/"), ("http://a.example/x?utm_source=1&b=2", "http://a.example/x"),
    ("http://a.example/x?b=2&gclid", "http://a.example/x"), ("http://a.example/x?b=2", "http://a.example/x?b=2"), ("http://a.example/x?notutm_source=1", "http://a.example/x?notutm_source=1"),
])
def test_urls(spark, url, expected):
    assert one(spark, U.normalize_url(F.col("x")), url) == expected


def test_hosts_and_links(spark):
    assert one(spark, U.host(F.col("x")), "https://a.example:81/x?y") == "a.example:81"
    page = """<a href="/x?q#f">1</a><a class=b href='http://b.example/y'>2</a><a href="//c.example">3</a><a href="z">4</a><a href="mailto:x@y">5</a><a>6</a><a href="/x">7</a>"""
    found = U.links_of(page, "http://a.example/d/e")
    assert found == ["http://a.example/x", "http://b.example/y", "http://c.example", "http://a.example/d/z", "http://a.example/x"]
    assert spark.createDataFrame([(page, "http://a.example/d/e")], "h string, b string").select(U.page_links("h", "b")).first()[0] == found
    assert U.links_of(None, None) == []


def test_link_extract_resolves_all_references(spark, tmp_path):
    """The registered query beside urljoin, for relative, unquoted and upper-case references."""
    from urllib.parse import urljoin

    from termforge.plans import catalog

    base = "http://a.example/d/e.html"
    hrefs = ["about.html", "../x", "HTTP://b.example/y", "//c.example/z", "/w", "https://d.example/", "./v/u"]
    page = "".join(f'<a href="{h}">x</a>' for h in hrefs) + "<a href=bare.html>x</a><a class=k href='one'>x</a><a href='?p=2'>x</a><a href='mailto:a@b'>x</a>"
    spark.createDataFrame([(1, base, page)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(r["target"] for r in catalog.QUERIES["link_extract"](spark, str(tmp_path)).collect())
    expected = [urljoin(base, h) for h in [*hrefs, "bare.html", "one"]] + [urljoin(base, "?p=2").split("?")[0]]
    assert found == sorted(u.replace("HTTP:", "http:") for u in expected)
