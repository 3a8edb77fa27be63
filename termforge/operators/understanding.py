"""Spelling, synonyms and intent of queries, for tables of queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions.constants import HEADS, MAX_TOKEN, NAVIGATIONAL, SYNONYMS, TRANSACTIONAL
from termforge.sources.shared import cut

MOST_EDITS = 2
#: Words up to which comparing each with every term is cheaper than sending forms of all terms.
FEW_WORDS = 1000


def intent(query: Column) -> Column:
    q = F.lower(F.trim(query))
    return F.when(q.rlike(NAVIGATIONAL), "navigational").when(q.rlike(TRANSACTIONAL), "transactional").otherwise("informational")


def intent_of(query: str) -> str:
    """``intent`` on the driver."""
    q = query.strip().lower()
    return "navigational" if re.search(NAVIGATIONAL, q) else "transactional" if re.search(TRANSACTIONAL, q) else "informational"


def corrections(words: DataFrame, vocabulary: DataFrame, most: int = MOST_EDITS) -> DataFrame:
    """(word, correction, distance) for words of more than two letters that aren't in the vocabulary. Ties go to the first term."""
    asked = words.select(F.lower("word").alias("word")).where(F.length("word") > 2).distinct()
    unknown = asked.join(vocabulary.withColumnRenamed("term", "word").hint("merge"), "word", "left_anti")  # a vocabulary is too large for the driver
    return nearest_terms(unknown, vocabulary, most)


def nearest_terms(unknown: DataFrame, vocabulary: DataFrame, most: int = MOST_EDITS, few: bool | None = None) -> DataFrame:
    """(word, correction, distance): the nearest term within ``most`` edits.

    Up to ``FEW_WORDS`` words (counted, unless ``few`` says so) are broadcast and compared with all terms of a fitting length where these
    are. More words meet the terms with which they share a form that is left after ``most`` deletions at most: strings within
    that many edits always do, so none is missed. Words that have a term within one edit aren't looked for within two.
    """
    if few is None:
        few = unknown.limit(FEW_WORDS + 1).count() <= FEW_WORDS
    if few:
        return _best(vocabulary.join(F.broadcast(unknown), F.abs(F.length("term") - F.length("word")) <= most), most)
    left, found = cut(unknown.select("word").where(F.length("word") <= MAX_TOKEN + most).distinct()), []
    for edits in range(min(1, most), most + 1):
        found.append(cut(_best(_sharing(left, vocabulary, edits), edits)))
        left = left.join(found[-1].select("word"), "word", "left_anti")
    return reduce(DataFrame.unionByName, found)


def _best(near: DataFrame, most: int) -> DataFrame:
    measured = near.withColumn("distance", F.levenshtein("word", "term", most)).where("distance >= 0")
    return measured.groupBy("word").agg(F.min(F.struct("distance", "term")).alias("best")).select("word", F.col("best.term").alias("correction"), F.col("best.distance").alias("distance"))


def _sharing(words: DataFrame, vocabulary: DataFrame, edits: int) -> DataFrame:
    """(word, term) that share a form, by its hash. Merged: Spark takes exploded forms for no larger than the words they are made of, and would broadcast them."""
    left = vocabulary.select("term", F.explode(F.transform(_deletions(F.col("term"), edits), lambda f: F.xxhash64(f))).alias("form"))
    right = words.select("word", F.explode(F.transform(_deletions(F.col("word"), edits), lambda f: F.xxhash64(f))).alias("form"))
    return left.hint("merge").join(right, "form").select("word", "term")


def _deletions(word: Column, most: int) -> Column:
    """The word and all that is left of it after up to ``most`` deletions, each once."""

    def shorter(w: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
        return F.when(F.length(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    forms = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        forms = F.array_union(forms, last)
    return forms


def process(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, original, rewritten, intent, expanded) of a table of queries (query_id, text): what the engine understands of one, for all in one job."""
    asked = queries.select("query_id", F.trim(F.coalesce("text", F.lit(""))).alias("original")).distinct()
    asked = cut(asked.withColumn("row", F.monotonically_increasing_id()))  # words go by it, lest each carries the whole text
    words = asked.select("row", F.posexplode_outer(F.filter(F.split(F.lower("original"), r"\s+"), lambda w: w != "")).alias("pos", "word"))
    fixed = corrections(words.where("word IS NOT NULL"), vocabulary).select(F.col("word").alias("wrong"), "correction")
    mended = words.join(fixed.hint("merge"), F.col("word") == F.col("wrong"), "left").withColumn("word", F.coalesce("correction", "word"))
    whole = mended.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))), lambda x: x["word"]).alias("words"))
    return asked.join(whole.hint("merge"), "row").select("query_id", "original", F.array_join("words", " ").alias("rewritten"), intent(F.col("original")).alias("intent"), expand(F.col("words")).alias("expanded"))


def _map(pairs: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def expand(words: Column) -> Column:
    """The words, each head's first two synonyms, and the head of each other synonym; no repeats, sorted."""
    added = {w: (h,) for w, h in HEADS.items() if w not in SYNONYMS} | {h: s[:2] for h, s in SYNONYMS.items()}
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(_map(added), w), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(words, more)))


def expand_words(words: list[str]) -> list[str]:
    """``expand`` on the driver."""
    out = set(words)
    for w in words:
        out.update(SYNONYMS[w][:2] if w in SYNONYMS else [HEADS[w]] if w in HEADS else [])
    return sorted(out)
