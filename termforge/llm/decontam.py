"""Benchmark decontamination by Wu-Manber multi-pattern search.

The test strings are all windows of ``words`` consecutive words of the benchmark items
(a shorter item is one string), lower-cased, with anything between words as one space. The search looks at the block of ``BLOCK``
characters that ends the current window: a table says how far the window may move on
without missing a string; where it may not, the strings that end their first ``m``
characters with this block are compared directly. An item of less than ``LEAST_WORDS`` words says too little to be looked for
inside other text; it is found in documents that say these words and nothing else.

The distinct strings are numbered in a table. Those of ``MOST_PATTERN_BYTES`` together are broadcast at a time, and a larger benchmark
is searched for in several passes; documents give numbers of strings, of which the distinct ones are counted
after all passes, so the number of passes changes nothing.

Defined results: null or empty (wordless) texts and items match nothing; repeated benchmark items are
reported under each of their item_ids; rows that share a doc_id count together, each string once; texts of any length are searched
whole; of ties there are none, as nothing is ranked; rows without doc_id are searched, and dropped by ``decontaminate`` if they match, but not
reported. An empty benchmark finds nothing and drops nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.common import cut, identified, table

WORDS, LEAST_WORDS, BLOCK = 8, 5, 6
MOST_PATTERN_BYTES = 64 << 20
_BETWEEN = r"[^\p{L}\p{N}_]+"


class WuManber:
    """Finds all occurrences of any of the strings in a text."""

    def __init__(self, patterns: list[str], block: int = BLOCK):
        self.patterns = sorted({p for p in patterns if p})
        self.m = min(map(len, self.patterns), default=0)
        self.block = b = max(1, min(block, self.m))
        self.default = self.m - b + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, list[tuple[str, int]]] = {}
        for number, p in enumerate(self.patterns):
            for end in range(b, self.m + 1):
                s = p[end - b : end]
                self.shift[s] = min(self.shift.get(s, self.default), self.m - end)
            self.bucket.setdefault(p[self.m - b : self.m], []).append((p, number))

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence, overlapping ones included."""
        if not self.patterns:
            return
        shift, bucket, default, m, b = self.shift.get, self.bucket, self.default, self.m, self.block
        end, n = m, len(text)
        while end <= n:
            s = text[end - b : end]
            move = shift(s, default)
            if move:
                end += move
                continue
            for p, number in bucket[s]:
                if text.startswith(p, end - m):
                    yield end - m, number
            end += 1


def plain(text: Column) -> Column:
    """Lower-cased words with one space between, before and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text.cast("string")), _BETWEEN, " ")), F.lit(" "))


def item_strings(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, string, whole), distinct: the windows of all items; ``whole`` marks those that must be the whole text."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.trim(plain(F.col("text"))).alias("text"))
    split = items.where("text != ''").select("item_id", F.split("text", " ").alias("w")).withColumn("n", F.least(F.size("w"), F.lit(words)))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda k: F.concat(F.lit(" "), F.array_join(F.slice("w", k, F.col("n")), " "), F.lit(" ")))
    return split.select("item_id", F.explode(windows).alias("string"), (F.col("n") < LEAST_WORDS).alias("whole")).distinct()


def _numbered(items: DataFrame, most: int) -> tuple[DataFrame, list]:
    """(number, string, whole, part), written; and the numbers of the parts, of about ``most`` bytes each."""
    strings = cut(items.select("string", "whole").distinct().withColumn("number", F.monotonically_increasing_id()))
    size = strings.agg(F.sum(F.octet_length("string"))).first()[0] or 0
    parts = -(-size // most)
    return strings.withColumn("part", F.pmod(F.xxhash64("string"), F.lit(max(1, parts)))), list(range(parts))


class _Part:
    """The strings of one part, broadcast; each task makes its tables from them once."""

    def __init__(self, strings: DataFrame, part: int):
        rows = strings.where(F.col("part") == part).select("string", "number", "whole").collect()
        self.held = strings.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

    def finder(self):
        number = {s: n for s, n, _ in self.held.value}
        whole = {s for s, _, alone in self.held.value if alone}
        machine = WuManber([s for s in number if s not in whole])
        names = [number[p] for p in machine.patterns]

        def find(text: str) -> Iterator[int]:
            if text in whole:
                yield number[text]
            for _, k in machine.find(text):
                yield names[k]

        return find


def _searcher(part: _Part):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = part.finder()
        for pdf in batches:
            rows = [(doc_id, number) for doc_id, text in zip(pdf["doc_id"], pdf["plain"]) for number in set(find(text))]
            yield pd.DataFrame(rows, columns=["doc_id", "number"], dtype="int64")

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, most: int = MOST_PATTERN_BYTES) -> DataFrame:
    """(doc_id, item_id, strings): how many distinct test strings of an item a document holds."""
    known = identified(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = known.select("doc_id", plain(F.col("text")).alias("plain"))
    items = cut(item_strings(benchmark, words))
    strings, parts = _numbered(items, most)
    schema = "doc_id bigint, number bigint"
    found = [texts.mapInPandas(_searcher(_Part(strings, k)), schema) for k in parts] or [docs.sparkSession.createDataFrame([], schema)]
    owners = items.join(strings, ["string", "whole"]).select("number", "item_id")
    return reduce(DataFrame.unionByName, found).distinct().join(owners, "number").groupBy("doc_id", "item_id").agg(F.count("*").alias("strings"))


def _leak_test(part: _Part):
    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = part.finder()
        for texts in batches:
            yield texts.map(lambda t: next(find(t), None) is not None).astype(bool)

    return leaks


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, text_col: str = "text", most: int = MOST_PATTERN_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test string, with all their columns."""
    strings, parts = _numbered(item_strings(benchmark, words), most)
    for k in parts:
        docs = docs.where(~_leak_test(_Part(strings, k))(F.coalesce(plain(F.col(text_col)), F.lit(""))))
    return docs


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items' test strings."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = "SELECT {id}, string_split(p, ' ') AS w FROM (SELECT {id}, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS p FROM {t} WHERE text IS NOT NULL AND {id} IS NOT NULL) WHERE p != ''"

ORACLE_OP6 = f"""
WITH i AS ({_SPLIT.format(id="item_id", t="benchmark")}), d AS ({_SPLIT.format(id="doc_id", t="documents")}),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT *, least({WORDS}, len(w)) AS n FROM i), unnest(range(1, len(w) - n + 2)) AS u(k)),
long AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k+n-1], ' ') AS g FROM (SELECT * FROM d, (SELECT DISTINCT n FROM item)), unnest(range(1, len(w) - n + 2)) AS u(k)
  WHERE n >= {LEAST_WORDS} OR len(w) = n)
SELECT doc_id, item_id, count(*) AS strings FROM long JOIN item USING (n, g) GROUP BY doc_id, item_id
"""
