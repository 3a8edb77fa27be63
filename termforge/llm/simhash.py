"""SimHash near-duplicates, with candidates pruned by pigeonring chains.

A fingerprint has 128 bits over the set of a text's words and word pairs. Two
documents are near duplicates if their fingerprints differ in at most ``tau`` bits.

The fingerprint is cut into ``m = tau + 1`` segments on a ring. If two
fingerprints differ in at most ``tau`` bits in all, some segment starts a chain whose
first ``l`` segments differ in at most ``l * tau / m`` bits, for every ``l``: so its
first segment is equal, the first two differ in one bit at most, and so on. Rows meet in
one group per (start, value of the first segments); inside a group the chain's next
segments split the work further, before the whole Hamming distance is looked at.
The search is exact: it finds every pair within ``tau``.

Defined results: a null or wordless text has no fingerprint and is nobody's
duplicate; equal fingerprints (copies, repeated rows) are joined by their smallest
doc_id before any pair is formed, so a group of a million copies makes no pairs; rows whose
doc_id is null can't be named in a result and are left out of groups (``deduplicate``
keeps them); rows that repeat a doc_id are one document; in a tie the smallest
doc_id stays; a fingerprint is over the whole text however long. An empty table gives an empty result. Other columns are ignored.

While groups are small one exact segment is the shuffle's key; for more rows the second segment joins it
(``GROUP_ROWS``). Either plan finds the same pairs. Pairs are compared and vetted a block at a time. For the groups of documents
only what is connected counts: there a chain group gives its links to the least node of each of its components and not all pairs, so
what it holds and returns grows with its rows, however many of them are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.llm.common import cut, identified, mix, slices, table, word_hashes

BITS = 128
TAU = 24
#: Rows in a group up to which one exact segment is a sufficient key for the shuffle.
GROUP_ROWS = 200_000
#: Rows on average that one call of the pair search gets, as some whole groups.
BUCKET_ROWS = 50_000
#: Pairs whose distance, and those whose segments' differences, are held at once; no limit to what is compared.
MOST_COMPARED, VETTED = 1 << 20, 1 << 13
#: Pairs of a chain group that wait until they are joined to components.
WAITING = 1 << 14
_BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32)
_LANES = (np.arange(8) * 256)[None, :]


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    lanes = (h.view(np.uint8).reshape(-1, 8) + _LANES).ravel()
    return (np.bincount(lanes, minlength=2048).reshape(8, 256).astype(np.float32) @ _BIT_TABLE).ravel()


def fingerprint_words(words: np.ndarray) -> tuple[int, int] | None:
    """The two halves, as signed 64-bit numbers, for a text's word hashes in order."""
    if not len(words):
        return None
    pairs = mix(words[:-1] * np.uint64(31) + words[1:])
    h = np.concatenate([words, pairs])
    h.sort()
    h = h[np.append(True, h[1:] != h[:-1])]
    bits = np.concatenate([_ones(h), _ones(mix(h))]) * 2 > len(h)
    hi, lo = np.packbits(bits, bitorder="little").view(np.int64)
    return int(hi), int(lo)


def fingerprint_texts(texts: list[str | None]) -> list[tuple[int, int] | None]:
    """Fingerprints of whole texts, None for those without words."""
    out: list[tuple[int, int] | None] = []
    texts = [t or "" for t in texts]
    for part in slices(texts):
        hashes, stops = word_hashes(texts[part])
        begin = 0
        for stop in stops:
            out.append(fingerprint_words(hashes[begin:stop]))
            begin = stop
    return out


def _fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = fingerprint_texts(pdf["text"].where(pdf["text"].notna(), None).tolist())
        keep = np.array([f is not None for f in found], dtype=bool)
        halves = np.array([f for f in found if f is not None], dtype=np.int64).reshape(-1, 2)
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[keep], "hi": halves[:, 0], "lo": halves[:, 1]})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo) for every row that has a doc_id and a word."""
    known = identified(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return known.mapInPandas(_fingerprint, "doc_id bigint, hi bigint, lo bigint")


def segments(tau: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ``tau + 1`` segments, whose widths differ by one at most."""
    m = tau + 1
    cuts = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _values(hi: np.ndarray, lo: np.ndarray, first: int, width: int) -> np.ndarray:
    """A segment's value; ``hi`` holds bits 0 to 63."""
    mask = np.uint64((1 << width) - 1)
    if first >= 64:
        return (lo >> np.uint64(first - 64)) & mask
    v = hi >> np.uint64(first)
    if first + width > 64:
        v = v | (lo << np.uint64(64 - first))
    return v & mask


def _column(first: int, width: int):
    """``_values`` as a Spark expression."""
    mask = F.lit((1 << width) - 1)
    if first >= 64:
        return F.shiftrightunsigned("lo", first - 64).bitwiseAND(mask)
    v = F.shiftrightunsigned("hi", first) if first else F.col("hi")
    if first + width > 64:
        v = v.bitwiseOR(F.shiftleft("lo", 64 - first))
    return v.bitwiseAND(mask)


def _masks(width: int, most: int) -> list[tuple[int, int]]:
    """(mask, bits set) of all flips of at most ``most`` bits."""
    return [(sum(1 << b for b in flip), n) for n in range(most + 1) for flip in combinations(range(width), n)]


class _Chains:
    """All pairs within tau between two sets whose chains start at segment ``start``; if ``linked``, what connects the same rows (by ascending node)."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, node: np.ndarray, start: int, tau: int, linked: bool = False):
        self.ring = segments(tau)
        self.hi, self.lo, self.node, self.start, self.tau, self.m = hi, lo, node, start, tau, len(self.ring)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.root, self.waiting = np.arange(len(node)) if linked else None, 0

    def join(self) -> None:
        """Found pairs become components; ``root`` is the first row of each row's."""
        a, b = (np.concatenate(side) for side in zip(*self.found)) if self.found else (np.zeros(0, np.int64),) * 2
        self.found, self.waiting = [], 0
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up

    def results(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(lesser nodes, greater nodes) of the pairs or links."""
        if self.root is not None:
            self.join()
            rows = np.flatnonzero(self.root != np.arange(len(self.root)))
            self.found = [(self.root[rows], rows)]
        return [(self.node[a], self.node[b]) for a, b in self.found]

    def pairs(self, a: np.ndarray, b: np.ndarray, at: int, used: int) -> None:
        """``a`` and ``b`` (row numbers) agree on the first ``at`` segments but for ``used`` bits."""
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= 1 << 18 or at >= 4:
            step = max(1, MOST_COMPARED // len(b))
            for k in range(0, len(a), step):
                rows = a[k : k + step]
                for j in range(0, len(b), MOST_COMPARED):
                    others = b[j : j + MOST_COMPARED]
                    d = np.bitwise_count(self.hi[rows, None] ^ self.hi[others])
                    d += np.bitwise_count(self.lo[rows, None] ^ self.lo[others])
                    x, y = np.nonzero(d <= self.tau)
                    if len(x):
                        self.vet(rows[x], others[y])
            return
        first, width = self.ring[(self.start + at) % self.m]
        parts = []
        for side in (a, b):
            v = _values(self.hi[side], self.lo[side], first, width).astype(np.int64)
            order = np.argsort(v, kind="stable")
            parts.append((side[order], np.searchsorted(v[order], np.arange((1 << width) + 1))))
        (sa, ca), (sb, cb) = parts
        for mask, n in _masks(width, min(width, (at + 1) * self.tau // self.m - used)):
            for v in range(1 << width):
                w = v ^ mask
                self.pairs(sa[ca[v] : ca[v + 1]], sb[cb[w] : cb[w + 1]], at + 1, used + n)

    def vet(self, a: np.ndarray, b: np.ndarray) -> None:
        """Keep the pairs, the lesser node first, for which ``start`` is the first segment that any full chain starts at.

        A chain that starts at ``k`` is full if no sum of ``m * difference - tau`` from there on is above 0;
        so the greatest of the next ``m`` sums around the ring may not be above that before ``k``.
        """
        lesser = self.node[a] < self.node[b]
        a, b = a[lesser], b[lesser]
        for at in range(0, len(a), VETTED):
            i, j = a[at : at + VETTED], b[at : at + VETTED]
            if self.root is not None:
                apart = self.root[i] != self.root[j]
                i, j = i[apart], j[apart]
            x, y = self.hi[i] ^ self.hi[j], self.lo[i] ^ self.lo[j]
            sums = np.zeros((self.m + 1, len(i)), np.int16)
            for k, s in enumerate(self.ring):
                sums[k + 1] = sums[k] + np.bitwise_count(_values(x, y, *s)).astype(np.int16) * np.int16(self.m) - np.int16(self.tau)
            after = np.maximum.accumulate(sums[:0:-1], axis=0)[::-1]  # of k + 1 to m
            before = np.maximum.accumulate(sums[:-1], axis=0) + sums[-1]  # of m + 1 to m + k, with that of m
            full = np.maximum(after, before) <= sums[:-1]
            keep = full.any(axis=0) & (full.argmax(axis=0) == self.start)
            if keep.any():
                self.found.append((i[keep], j[keep]))
                self.waiting += int(keep.sum())
            if self.root is not None and self.waiting >= WAITING:
                self.join()


def _bucket_pairs(tau: int, linked: bool):
    """All pairs, or the links, of the chain groups (start, key) that one bucket holds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "key", "node"], kind="stable")
        group = pdf["start"].to_numpy().astype(np.int64) << 32 | pdf["key"].to_numpy()
        hi, lo = pdf["hi"].to_numpy().view(np.uint64), pdf["lo"].to_numpy().view(np.uint64)
        node, flips, starts = pdf["node"].to_numpy(), pdf["flip"].to_numpy(), pdf["start"].to_numpy()
        depth = 2 if pdf["deep"].iloc[0] else 1
        edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        found = []
        for begin, end in zip(edges, edges[1:]):
            if end - begin < 2:
                continue
            part = slice(begin, end)
            own, flipped = np.flatnonzero(flips[part] == 0), np.flatnonzero(flips[part] != 0)
            chains = _Chains(hi[part], lo[part], node[part], int(starts[begin]), tau, linked)
            chains.pairs(own, own, depth, 0)
            chains.pairs(flipped, own, depth, 1)
            found += chains.results()
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"a": np.concatenate([a for a, _ in found] or none), "b": np.concatenate([b for _, b in found] or none)})

    return run


def close_pairs(nodes: DataFrame, tau: int = TAU, linked: bool = False) -> DataFrame:
    """(a, b), a < b: all pairs of ``nodes`` (node, hi, lo; distinct fingerprints) within ``tau`` bits; if ``linked``, fewer pairs that connect the same nodes.

    While a segment's values make groups of at most ``GROUP_ROWS`` rows on average, one exact
    segment is the shuffle's key; beyond, the second segment joins the key, and a
    row is also sent to the values that differ from its own in one bit.
    """
    ring, m = segments(tau), tau + 1
    rows = nodes.count()
    deep = rows > GROUP_ROWS << min(w for _, w in ring)
    sends = []
    for k, (first, width) in enumerate(ring):
        key = _column(first, width)
        if not deep:
            sends.append(F.struct(F.lit(k).alias("start"), key.alias("key"), F.lit(0).alias("flip")))
            continue
        nxt, wide = ring[(k + 1) % m]
        for mask, n in _masks(wide, 2 * tau // m):
            joint = F.shiftleft(key, wide).bitwiseOR(_column(nxt, wide).bitwiseXOR(F.lit(mask)))
            sends.append(F.struct(F.lit(k).alias("start"), joint.alias("key"), F.lit(n).alias("flip")))
    sent = nodes.select("node", "hi", "lo", F.explode(F.array(*sends)).alias("s"))
    buckets = max(1, rows * len(sends) // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("s.start", "s.key"), F.lit(buckets)).alias("bucket")
    sent = sent.select(bucket, "s.start", "s.key", "s.flip", "node", "hi", "lo", F.lit(deep).alias("deep"))
    return sent.groupBy("bucket").applyInPandas(_bucket_pairs(tau, linked), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) is connected with.

    Large-star and small-star in turn: each round writes its edges to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    Stars, which is what groups of copies make, are done after one round.
    """
    edges = cut(edges.select("a", "b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        stars = both.select(F.col("a").alias("u"), F.col("b").alias("v")).withColumn("low", low)
        large = stars.where("v > u AND v != low").select(F.col("low").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        root = F.min("v").over(Window.partitionBy("u"))
        small = down.withColumn("low", root).select(F.col("low").alias("a"), F.explode(F.array("u", "v")).alias("b"))
        edges = cut(small.where("a != b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("bigint"))).first())
        if now == before:
            return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, group_id, copies, kept) for every document that has a duplicate.

    ``group_id`` is the group's smallest doc_id, ``copies`` counts its documents, ``kept``
    marks the one that stays.
    """
    prints = cut(fingerprints(docs).distinct())
    nodes = cut(prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")))
    roots = components(close_pairs(nodes, tau, linked=True))
    named = nodes.join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("group_id"))
    members = prints.join(named, ["hi", "lo"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    sized = members.withColumn("copies", F.count("*").over(Window.partitionBy("group_id")))
    return sized.where("copies > 1").select("doc_id", "group_id", "copies", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def deduplicate(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one document of each group; all columns stay.

    Rows that share a doc_id are one document, of which the row with the least text
    hash stays; rows without doc_id stay as they are.
    """
    gone = near_duplicates(identified(docs, id_col, text_col), tau).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    number = F.col(id_col).cast("bigint")
    known = docs.where(number.isNotNull()).withColumn("__id", number)
    left = known.join(gone, known["__id"] == gone["__gone"], "left_anti")
    order = Window.partitionBy("__id").orderBy(F.xxhash64(F.col(text_col).cast("string")))  # the join's own partitioning
    once = left.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth", "__id")
    return once.unionByName(docs.where(number.isNull()))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
