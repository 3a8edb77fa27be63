"""Content extraction by wrapper induction from pages of the same host.

Each page's DOM is aligned with that of its host's first page that has text (the seed) by simple tree
matching: nodes match if their tags do and their parents match, children in order, and the
matching has the greatest weight. What stays unmatched is aligned with the first page of the page's own
layout, if two pages of the host have this at least; a layout is the set of paths of container elements.
Text nodes that match the same node of a seed fill the same slot. A text is constant in a slot if at least half of the
different pages that have the slot, and two at least, say it there: this is template. Pages that say the same in all slots are
copies and vote once. Other texts, and text nodes without a counterpart in either seed, are content.

Pages stay where they are: a first pass finds layouts, from which seeds are chosen by number and hash; a second aligns and sends only
slots and hashes of texts to be counted; the last aligns again and leaves the constants out. Seeds and constants, which grow with the
number of hosts and layouts and not of pages, are broadcast if the seeds have at most ``MOST_SEED_BYTES``; beyond, pages meet
their host's seeds in groups, of which a host has as many as its pages need. The results are the same.

Defined results: a host is the lower-cased authority of the URL, '' without one; a host of which there is only one different page has no
template; null or empty pages have no slots and empty content; of several first pages (equal page_id, or none)
the one with the least hash is the seed; two texts that half of a slot's pages each say are both constant;
rows without page_id keep their content, without an id. Pages of any length are aligned whole, in memory that grows with the
longer list of children and time with the product of the two lists' unequal middles. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termforge.llm.common import cut, table

#: Pages of a host in one group, on average at most; share of a slot's pages that a constant has at least.
GROUP_PAGES, SHARE, LEAST_PAGES = 500, 0.5, 2
#: Bytes of all seeds up to which they are broadcast; pages whose results are held at once.
MOST_SEED_BYTES, PIECE = 32 << 20, 500
_TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)[^>]*>", re.S | re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_CONTAINERS = frozenset("body div ul ol table section article nav aside main dl header footer form".split())
_BARRIER = frozenset("body div ul ol table section article nav aside main dl select".split())


class Node:
    """An element, or a text (tag ``#``). ``whole`` identifies the subtree, ``weight`` is that of its full match."""

    __slots__ = ("tag", "kids", "text", "number", "whole", "weight")

    def __init__(self, tag: str, text: str | None = None):
        self.tag, self.text, self.kids = tag, text, []


def parse(page: str | None) -> list[Node]:
    """The DOM in document order; the first node is the root."""
    root = Node("html")
    nodes, open_nodes, at = [root], [root], 0

    def add(node: Node) -> None:
        open_nodes[-1].kids.append(node)
        nodes.append(node)

    def say(text: str) -> None:
        words = " ".join(entities.unescape(text).split())
        if words:
            add(Node("#", words))

    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag == "html":
            continue
        if m[2]:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    del open_nodes[k:]
                    break
            continue
        closes = _CLOSES.get(tag)
        if closes:
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag in closes:
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag in _BARRIER:
                    break
        node = Node(tag)
        add(node)
        if tag not in _VOID and not m[0].endswith("/>"):
            open_nodes.append(node)
    say(page[at:])
    for number, node in enumerate(nodes):
        node.number = number
    for node in reversed(nodes):  # children come after their parents
        node.whole = hash((node.tag, node.text, *(k.whole for k in node.kids)))
        node.weight = (3 if node.tag == "#" else 2) + sum(k.weight for k in node.kids)
    return nodes


#: Pairs of children up to which plain lists are quicker than arrays.
_FEW = 2048


class Matching:
    """The heaviest simple tree matching of two DOMs: 2 for a match, and 1 more for an equal text.

    Equal children at either end of two lists match each other first: no other matching is heavier. What is left is aligned
    by rows; for long lists as arrays, of which only every so many are kept and those between made anew for the way back.
    """

    def __init__(self, a: Node, b: Node):
        self.known: dict[tuple[int, int], int] = {}
        self.seed_of: dict[int, int] = {}
        sys.setrecursionlimit(1_000_000)
        if self.weight(a, b):
            self.follow(a, b)

    @staticmethod
    def ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
        """How many children are equal at the start, and at the end."""
        most = min(len(x), len(y))
        head = 0
        while head < most and x[head].whole == y[head].whole:
            head += 1
        tail = 0
        while tail < most - head and x[-1 - tail].whole == y[-1 - tail].whole:
            tail += 1
        return head, tail

    def table(self, x: list[Node], y: list[Node]) -> list[list[int]]:
        above = [0] * (len(y) + 1)
        rows = [above]
        for u in x:
            row, left = [0], 0
            for k, v in enumerate(y):
                best = above[k] + self.weight(u, v) if u.tag == v.tag else 0
                left = max(left, above[k + 1], best)
                row.append(left)
            rows.append(row)
            above = row
        return rows

    def weight(self, a: Node, b: Node) -> int:
        if a.tag != b.tag:
            return 0
        if a.whole == b.whole:
            return a.weight
        if a.tag == "#":
            return 2
        if not a.kids or not b.kids:
            return 2
        key = (a.number, b.number)
        found = self.known.get(key)
        if found is None:
            head, tail = self.ends(a.kids, b.kids)
            x, y = a.kids[head : len(a.kids) - tail], b.kids[head : len(b.kids) - tail]
            found = 2 + sum(k.weight for k in a.kids[:head]) + sum(k.weight for k in a.kids[len(a.kids) - tail :])
            if len(x) == 1 == len(y):
                found += self.weight(x[0], y[0])
            elif x and y:
                found += self.table(x, y)[-1][-1] if len(x) * len(y) <= _FEW else int(_Wide(self, x, y).total)
            self.known[key] = found
        return found

    def follow(self, a: Node, b: Node) -> None:
        """Note which node of ``a`` each node of ``b`` matches."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seed_of[b.number] = a.number
            if a.whole == b.whole:
                todo += zip(a.kids, b.kids)
                continue
            head, tail = self.ends(a.kids, b.kids)
            x, y = a.kids[head : len(a.kids) - tail], b.kids[head : len(b.kids) - tail]
            todo += zip(a.kids[:head], b.kids[:head])
            todo += zip(a.kids[len(a.kids) - tail :], b.kids[len(b.kids) - tail :])
            if len(x) * len(y) > _FEW:
                todo += _Wide(self, x, y).matched()
                continue
            rows = self.table(x, y)
            i, j = len(x), len(y)
            while i and j:
                u, v = x[i - 1], y[j - 1]
                if u.tag == v.tag and rows[i][j] == rows[i - 1][j - 1] + self.weight(u, v):
                    todo.append((u, v))
                    i, j = i - 1, j - 1
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1


class _Wide:
    """The alignment of two long lists. Children that differ only in texts which the other list doesn't have weigh alike."""

    def __init__(self, within: Matching, x: list[Node], y: list[Node]):
        both = self._texts(x) & self._texts(y)
        names: dict[int, int] = {}
        self.x, self.y, self.within = x, y, within
        self.kinds = [self._kind(u, both) for u in x]
        self.kind_y = np.array([names.setdefault(self._kind(v, both), len(names)) for v in y])
        self.one_y = [y[k] for k in np.unique(self.kind_y, return_index=True)[1]]
        self.weights: dict[int, np.ndarray] = {}
        self.step = max(1, int(len(x) ** 0.5))
        row = np.zeros(len(y) + 1, np.int32)
        self.kept = []
        for i in range(len(x)):
            if i % self.step == 0:
                self.kept.append(row)
            row = self._next(row, i)
        self.total = row[-1]

    @staticmethod
    def _texts(nodes: list[Node]) -> set[str]:
        found, todo = set(), list(nodes)
        while todo:
            node = todo.pop()
            if node.tag == "#":
                found.add(node.text)
            todo += node.kids
        return found

    def _kind(self, node: Node, both: set[str]) -> int:
        if node.tag == "#":
            return hash(("#", node.text if node.text in both else None))
        return hash((node.tag, *(self._kind(k, both) for k in node.kids)))

    def _row(self, i: int) -> np.ndarray:
        """Weights of the child ``i`` with all others."""
        kind = self.kinds[i]
        if kind not in self.weights:
            if len(self.weights) * len(self.one_y) > 1 << 22:
                self.weights.clear()
            self.weights[kind] = np.array([self.within.weight(self.x[i], v) for v in self.one_y], np.int32)
        return self.weights[kind][self.kind_y]

    def _next(self, above: np.ndarray, i: int) -> np.ndarray:
        row = above.copy()
        np.maximum(above[1:], above[:-1] + self._row(i), out=row[1:])
        return np.maximum.accumulate(row)

    def matched(self) -> list[tuple[Node, Node]]:
        found, j = [], len(self.y)
        for block in range(len(self.kept) - 1, -1, -1):
            begin = block * self.step
            rows = [self.kept[block]]
            for i in range(begin, min(begin + self.step, len(self.x))):
                rows.append(self._next(rows[-1], i))
            i = begin + len(rows) - 1
            while i > begin and j:
                row, above = rows[i - begin], rows[i - begin - 1]
                weight = self.weights[self.kinds[i - 1]][self.kind_y[j - 1]] if self.kinds[i - 1] in self.weights else self._row(i - 1)[j - 1]
                if weight and row[j] == above[j - 1] + weight:
                    found.append((self.x[i - 1], self.y[j - 1]))
                    i, j = i - 1, j - 1
                elif row[j] == above[j]:
                    i -= 1
                else:
                    j -= 1
        return found


def slots(seed: Node, page: list[Node]) -> list[tuple[int, str]]:
    """(number of the seed's node or -1, text) of all the page's text nodes in order."""
    matched = Matching(seed, page[0]).seed_of
    return [(matched.get(n.number, -1), n.text) for n in page if n.tag == "#"]


def layout(page: list[Node]) -> int | None:
    """A number for the page's set of paths of containers; none for a page without text."""
    if not any(n.tag == "#" for n in page):
        return None
    names, known = {"html"}, {page[0].number: 0}
    for node in page:  # parents come before their children
        at = known[node.number]
        for kid in node.kids:
            known[kid.number] = at
            if kid.tag in _CONTAINERS:
                known[kid.number] = zlib.crc32(kid.tag.encode(), at)
                names.add(str(known[kid.number]))
    return zlib.crc32(" ".join(sorted(names)).encode()) & 0x7FFFFFFF


def _layouts(html: pd.Series) -> pd.Series:
    return pd.Series([layout(parse(h if isinstance(h, str) else None)) for h in html], dtype="Int64")


class Wrapper:
    """What is known of a host: the pages its pages are aligned with, and the constants once they are counted."""

    def __init__(self, layouts: list[int], pages: list[str], main: list[bool], constants: Iterable[tuple[int, int]] = ()):
        self.pages, self.main, self.constants = dict(zip(layouts, pages)), next(k for k, first in zip(layouts, main) if first), set(constants)
        self.roots: dict[int, Node] = {}

    def root(self, k: int) -> Node:
        if k not in self.roots:
            self.roots[k] = parse(self.pages[k])[0]
        return self.roots[k]

    def slots(self, page: list[Node]) -> list[tuple[int, str]]:
        """(slot or -1, text) of the page's text nodes in order."""
        own = slots(self.root(self.main), page)
        if any(s < 0 for s, _ in own) and (kind := layout(page)) != self.main and kind in self.pages:
            more = slots(self.root(kind), page)
            own = [(s if s >= 0 or m < 0 else (kind + 1 << 32) + m, t) for (s, t), (m, _) in zip(own, more)]
        return own


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Few pages at a time, so that what is made of them stays small."""
    for batch in batches:
        for begin in range(0, len(batch), PIECE):
            yield batch.iloc[begin : begin + PIECE]


def _votes(wrapper_of: Callable[[str], Wrapper | None], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, page, slots, keys) of pages of hosts that have a wrapper: a hash of all the page says, and its slots with hashes of their texts."""
    for pages in _pieces(batches):
        hosts, said, found, keys = [], [], [], []
        for host, html in zip(pages["host"], pages["html"]):
            wrapper = wrapper_of(host)
            own = wrapper.slots(parse(html)) if wrapper and isinstance(html, str) else []
            slots = np.array([s for s, _ in own if s >= 0], np.int64)
            if len(slots):
                hosts.append(host)
                found.append(slots)
                keys.append(np.array([_hash(t) for s, t in own if s >= 0], np.int64))
                said.append(_hash("\n".join(f"{s} {t}" for s, t in own)))
        yield pd.DataFrame({"host": pd.Series(hosts, dtype=object), "page": pd.Series(said, dtype="int64"), "slots": pd.Series(found, dtype=object), "keys": pd.Series(keys, dtype=object)})


def _contents(wrapper_of: Callable[[str], Wrapper | None], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The result's rows, one for each page."""
    for pages in _pieces(batches):
        nodes, contents, fixed = [], [], []
        for host, html in zip(pages["host"], pages["html"]):
            page, wrapper = parse(html if isinstance(html, str) else None), wrapper_of(host)
            if wrapper and wrapper.constants:
                own = wrapper.slots(page)
                rest = [t for s, t in own if s < 0 or (s, _hash(t)) not in wrapper.constants]
            else:
                own = rest = [n.text for n in page if n.tag == "#"]
            nodes.append(len(own))
            fixed.append(len(own) - len(rest))
            contents.append("\n".join(rest))
        yield pd.DataFrame({"page_id": pages["page_id"].astype("Int64"), "host": pages["host"], "nodes": nodes, "template_nodes": fixed, "content": contents})


def _wrapper(seeds: pd.DataFrame) -> Wrapper | None:
    if not len(seeds):
        return None
    constants = seeds["constants"].iloc[0] if "constants" in seeds else None
    return Wrapper(seeds["layout"].tolist(), seeds["html"].tolist(), seeds["main"].tolist(), [(c["slot"], c["key"]) for c in constants] if constants is not None else ())


def _over_pages(known: DataFrame, seeds: DataFrame, groups: DataFrame, small: bool, make: Callable, schema: str) -> DataFrame:
    """``make`` over all pages with their hosts' seeds: broadcast if they are small, else each host's pages meet its seeds in groups."""
    if small:
        held = known.sparkSession.sparkContext.broadcast({host: own.drop(columns="host") for host, own in seeds.toPandas().groupby("host")})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wrappers: dict[str, Wrapper | None] = {}

            def wrapper_of(host: str) -> Wrapper | None:
                if host not in wrappers:
                    wrappers[host] = _wrapper(held.value[host]) if host in held.value else None
                return wrappers[host]

            return make(wrapper_of, batches)

        return known.mapInPandas(run, schema)

    names = StructType.fromDDL(schema).names

    def of_host(pages: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        wrapper = _wrapper(own)
        return pd.concat([pd.DataFrame(columns=names), *make(lambda _: wrapper, iter([pages]))], ignore_index=True).astype(object)

    spread = groups.where("groups > 1").select(F.col("host").alias("hot"), "groups")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("groups", F.lit(1)))  # not by content: copies are spread too
    pages = known.join(spread, F.col("host") == F.col("hot"), "left").select("page_id", "host", "html", salt.alias("part"))
    copies = seeds.join(groups, "host").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1))).drop("groups")
    return pages.groupBy("host", "part").cogroup(copies.groupBy("host", "part")).applyInPandas(of_host, schema)


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(page_id, host, nodes, template_nodes, content) of every page; content has a line for each text node."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    known = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    place = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("number"), F.xxhash64("html").alias("text"))
    kinds = known.select("host", place.alias("place"), F.pandas_udf(_layouts, "bigint")("html").alias("layout"))
    layouts = cut(kinds.groupBy("host", "layout").agg(F.min("place").alias("place"), F.count("*").alias("pages")))
    hosts = layouts.groupBy("host").agg(F.sum("pages").alias("pages"), F.min_by("layout", F.when(F.col("layout").isNotNull(), F.col("place"))).alias("first"))
    hosts = hosts.where(f"pages >= {LEAST_PAGES} AND first IS NOT NULL").select("host", "first", F.ceil(F.col("pages") / GROUP_PAGES).alias("groups"))
    chosen = cut(layouts.join(hosts, "host").where("layout = first OR layout IS NOT NULL AND pages > 1").select("host", "layout", "place", (F.col("layout") == F.col("first")).alias("main"), "groups"))
    groups = chosen.select("host", "groups").distinct()
    found = known.withColumn("place", place).join(chosen.drop("groups"), ["host", "place"])
    seeds = cut(found.groupBy("host", "layout").agg(F.any_value("html").alias("html"), F.any_value("main").alias("main")))
    small = (seeds.agg(F.sum(F.octet_length("html"))).first()[0] or 0) <= MOST_SEED_BYTES
    votes = _over_pages(known, seeds, groups, small, _votes, "host string, page bigint, slots array<bigint>, keys array<bigint>")
    once = votes.groupBy("host", "page").agg(F.any_value(F.arrays_zip(F.col("slots").alias("slot"), F.col("keys").alias("key"))).alias("s")).select("host", F.inline("s"))
    total = once.groupBy("host", "slot").agg(F.count("*").alias("total"))
    same = once.groupBy("host", "slot", "key").agg(F.count("*").alias("n")).where(f"n >= {LEAST_PAGES}")
    constant = same.join(total, ["host", "slot"]).where(F.col("n") >= share * F.col("total"))
    template = cut(constant.groupBy("host").agg(F.collect_list(F.struct("slot", "key")).alias("constants")))
    return _over_pages(known, seeds.join(template, "host"), groups, small, _contents, "page_id bigint, host string, nodes int, template_nodes int, content string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of all pages."""
    return extract(table(spark, sf_dir, "pages"))
