import random
import time
from collections import Counter, defaultdict

import pytest

from termforge.llm import wrappers as wr


def heaviest(a, b):
    """The greatest weight of a simple tree matching, by trying all alignments."""
    if a.tag != b.tag:
        return 0
    if a.tag == "#":
        return 3 if a.text == b.text else 2

    def align(i, j):
        if i == len(a.kids) or j == len(b.kids):
            return 0
        return max(align(i + 1, j), align(i, j + 1), heaviest(a.kids[i], b.kids[j]) + align(i + 1, j + 1))

    return 2 + align(0, 0)


def tree(rng, depth=3):
    node = wr.Node(rng.choice("ab")) if depth else wr.Node("#", rng.choice("xyz"))
    if depth:
        node.kids = [tree(rng, rng.choice([0, depth - 1])) for _ in range(rng.randint(0, 3))]
    return node


def page_of(node):
    return node.text if node.tag == "#" else f"<{node.tag}>{'<i></i>'.join(map(page_of, node.kids))}</{node.tag}>"


@pytest.mark.parametrize("seed", range(40))
def test_matching_is_the_heaviest(seed):
    rng = random.Random(seed)
    a, b = (wr.parse(page_of(tree(rng))) for _ in range(2))
    m = wr.Matching(a[0], b[0])
    assert m.weight(a[0], b[0]) == heaviest(a[0], b[0])
    weight = 0
    for number, to in m.seed_of.items():
        x, y = a[to], b[number]
        assert x.tag == y.tag
        weight += 2 + (x.tag == "#" and x.text == y.text)
    assert weight == heaviest(a[0], b[0]) and len(set(m.seed_of.values())) == len(m.seed_of)


def test_parsing():
    nodes = wr.parse("<!doctype html><html><p>a &amp; b<p>c<br>d<script>var x = '<p>no</p>';</script><ul><li>1<li>2</ul><!-- no -->e")
    assert [n.text for n in nodes if n.tag == "#"] == ["a & b", "c", "d", "1", "2", "e"]
    assert [n.tag for n in nodes[0].kids] == ["p", "p"]
    assert len(wr.parse(None)) == 1 == len(wr.parse(""))


def by_hand(pages):
    """(page number, content) for pages (number, host, html), with a dictionary for each host; equal pages vote once."""
    hosts = defaultdict(list)
    for p in pages:
        hosts[p[1]].append(p)
    out = []
    for own in hosts.values():
        seed = wr.parse(min(own, key=lambda p: p[0])[2])[0]
        found = [(p[0], wr.slots(seed, wr.parse(p[2]))) for p in own]
        said = defaultdict(Counter)
        for slots in {tuple(slots) for _, slots in found}:
            for s, t in slots:
                if s >= 0:
                    said[s][t] += 1
        fixed = {(s, t) for s, c in said.items() for t, n in c.items() if n >= max(2, 0.5 * sum(c.values()))}
        out += [(number, "\n".join(t for s, t in slots if (s, t) not in fixed)) for number, slots in found]
    return sorted(out)


@pytest.mark.parametrize("most", [wr.MOST_SEED_BYTES, -1])
def test_query_against_brute_force(spark, sf_dir, monkeypatch, most):
    """With seeds broadcast, and with pages grouped by host."""
    monkeypatch.setattr(wr, "MOST_SEED_BYTES", most)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    host = lambda u: u.split("//", 1)[1].split("/", 1)[0].split("?")[0].split("#")[0].lower()
    found = sorted((r["page_id"], r["content"]) for r in wr.op5_html_extraction(spark, sf_dir).collect())
    assert found == by_hand([(p["page_id"], host(p["url"]), p["html"]) for p in pages])


@pytest.mark.parametrize("seed", range(30))
def test_long_lists_are_matched_as_short_ones(seed, monkeypatch):
    rng = random.Random(seed)
    kid = lambda: rng.choice(["<p>{}</p>", "<p><b>{}</b>x</p>", "<i>{}</i>", "<p>{}<b>y</b></p>"]).format(rng.choice("abcdefgh"))
    a, b = (wr.parse("".join(kid() for _ in range(rng.randint(0, 60)))) for _ in range(2))
    short = wr.Matching(a[0], b[0])
    monkeypatch.setattr(wr, "_FEW", 0)
    long = wr.Matching(a[0], b[0])
    assert long.weight(a[0], b[0]) == short.weight(a[0], b[0]) and long.seed_of == short.seed_of


def test_very_long_pages_are_aligned_whole():
    texts = lambda side: "".join(f"<p>{side} {k}</p>" for k in range(10_000))
    began = time.perf_counter()
    seed, page = wr.parse("<h1>same</h1>" + texts("a"))[0], wr.parse("<h1>same</h1>" + texts("b") + "<p>more</p>")
    found = wr.slots(seed, page)
    assert sum(s >= 0 for s, _ in found) == 10_001 and time.perf_counter() - began < 60


def test_template_goes_and_content_stays(spark):
    page = "<html><head><title>Site</title></head><body><div><a>Home</a><a>About</a></div><h1>{}</h1><p>{}</p>{}<div>All rights reserved</div></body></html>"
    rows = [(k, "http://A.example/p", page.format(f"Title {k}", f"Body {k}", f"<p>More {k}</p>" * (k % 3))) for k in range(12)]
    found = wr.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    for r in found:
        k = r["page_id"]
        assert r["content"].split("\n") == [f"Title {k}", f"Body {k}", *[f"More {k}"] * (k % 3)] and r["template_nodes"] == 4 and r["host"] == "a.example"


def test_hot_hosts_are_spread_without_change(spark, monkeypatch):
    monkeypatch.setattr(wr, "MOST_SEED_BYTES", -1)
    rows = [(k, "http://a.example/", f"<p>Same</p><p>Own {k}</p>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    whole = sorted(map(tuple, wr.extract(pages).collect()))
    monkeypatch.setattr(wr, "GROUP_PAGES", 7)
    assert sorted(map(tuple, wr.extract(pages).collect())) == whole


def test_hard_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://a.example", None, "x", 1), (2, "http://a.example", "", "x", 1), (None, "http://a.example", "<p>x", "x", 1), (3, None, "<p>alone", "x", 1), (4, "b", "<p>alone too", None, None),
            (5, "http://c.example", deep, None, None), (5, "http://c.example", deep, None, None), (6, "http://d.example", "<p>only</p>" * 2000, None, None), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, part int")
    found = wr.extract(pages).collect()
    by = {r["page_id"]: r for r in found}
    assert len(found) == len(rows) and by[1]["nodes"] == 0 and by[1]["content"] == "" and by[6]["nodes"] == 2000 and by[6]["template_nodes"] == 0
    assert by[5]["content"] == "deep" and by[5]["template_nodes"] == 0  # one page, twice, is no template
    assert wr.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("first", [None, "", "<p>Not found", "<table><tr><td>Old</td></tr></table>"])
def test_one_page_does_not_stand_for_the_host(spark, first):
    """The first page is null, empty, an error page or of another layout; the host has two layouts besides."""
    article = "<body><nav><a>Home</a></nav><div><p>Text {}</p></div><footer>Imprint</footer></body>"
    listing = "<body><header><h2>All items</h2></header><ul><li>Item {}</li></ul><aside>Advice</aside></body>"
    rows = [(0, "http://a.example/", first)] + [(k, "http://a.example/", (article if k % 2 else listing).format(k)) for k in range(1, 13)]
    found = {r["page_id"]: r["content"] for r in wr.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [found[k] for k in range(1, 13)] == [f"{'Text' if k % 2 else 'Item'} {k}" for k in range(1, 13)]


def test_copies_vote_once(spark):
    """An article with many copies stays content beside other pages; the template still goes."""
    page = "<body><nav><a>Home</a></nav><p>Text {}</p></body>"
    rows = [(k, "http://a.example/", page.format(min(k, 3))) for k in range(12)]
    found = {r["page_id"]: r["content"] for r in wr.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {k: f"Text {min(k, 3)}" for k in range(12)}
