"""Strict evaluation of boolean and phrase queries over postings, as sets of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def having_term(stream: DataFrame, term: str) -> DataFrame:
    return stream.where(F.col("term") == term).select("doc_id").distinct()


def having_any(stream: DataFrame, terms: list[str]) -> DataFrame:
    return stream.where(F.col("term").isin(*terms)).select("doc_id").distinct()


def having_all(stream: DataFrame, terms: list[str]) -> DataFrame:
    """One pass and one shuffle, however many terms."""
    wanted = sorted(set(terms))
    found = stream.where(F.col("term").isin(*wanted)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("doc_id")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def having_phrase(stream: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with the terms in a row: each occurrence votes for where the phrase would start."""
    if not terms:
        return stream.select("doc_id").limit(0)
    places = {t: [k for k, other in enumerate(terms) if other == t] for t in terms}
    known = F.create_map(*[x for t, ks in places.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))])
    hits = stream.where(F.col("term").isin(*places)).select("doc_id", "pos", F.explode(known[F.col("term")]).alias("k"))  # one pass for all words
    votes = hits.select("doc_id", (F.col("pos") - F.col("k")).alias("start"), "k")
    return votes.groupBy("doc_id", "start").agg(F.count_distinct("k").alias("n")).where(F.col("n") == len(terms)).select("doc_id").distinct()
