"""Postings and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.functions.codec import vbyte_size
from termforge.sources.shared import cut

#: Rows that a task of Python hands on at once.
ROWS_OUT = 50_000


def spread(docs: DataFrame) -> DataFrame:
    """As they are, unless they are read in fewer parts than there are cores: a small file of one row group would be one task's work.

    What comes out of a shuffle is left alone: to count its parts would be to run it.
    """
    if docs.isStreaming:
        return docs
    plan, cores = docs._jdf.queryExecution().executedPlan(), docs.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return docs
    return docs.repartition(cores) if plan.execute().getNumPartitions() < cores else docs


def token_stream(docs: DataFrame, text_col: str = "text", only: list[str] | None = None) -> DataFrame:
    """(doc_id, pos, term): positions count kept tokens only. No shuffle: a document is one row. ``only`` leaves out all other terms before they are stemmed."""
    return _stream(docs, text_col, only).select("doc_id", "pos", "term")


def _stream(docs: DataFrame, text_col: str, only: list[str] | None = None) -> DataFrame:
    """With doc_len besides."""
    kept = spread(docs.select("doc_id", text_col)).select("doc_id", T.tokens(T.normalize(F.col(text_col))).alias("kept"))
    sized = kept.select("doc_id", F.size("kept").cast("bigint").alias("doc_len"), "kept")  # before it is exploded, lest each token carries the array
    # outer: else Spark would ask first whether there are tokens, and make them twice
    raw = sized.select("doc_id", "doc_len", F.posexplode_outer("kept").alias("pos", "raw")).where("raw IS NOT NULL")
    raw = raw if only is None else raw.where(F.col("raw").isin(*T.unstemmed(only)))
    return raw.select("doc_id", "doc_len", "pos", T.stem(F.col("raw")).alias("term"))  # tokens and their stems have MIN_TERM letters at least


def matched(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, tf, doc_len) of some terms alone, and (doc_id, doc_len) of all documents.

    Texts are read once, and what is kept of them is written; only tokens that may be one of the terms are exploded or shuffled.
    """
    kept = spread(docs.select("doc_id", text_col)).select("doc_id", T.tokens(T.normalize(F.col(text_col))).alias("kept"))
    found = cut(kept.select("doc_id", F.size("kept").cast("bigint").alias("doc_len"), F.filter("kept", lambda t: t.isin(*T.unstemmed(terms))).alias("kept")))
    some = found.select("doc_id", "doc_len", F.explode("kept").alias("raw")).select("doc_id", "doc_len", T.stem(F.col("raw")).alias("term"))
    return some.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.any_value("doc_len").alias("doc_len")), found.select("doc_id", "doc_len")


def token_offsets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, term, position, start_char, end_char) of the kept tokens. ``ROWS_OUT`` rows leave at a time, however long the texts are."""
    kind = pa.schema([("doc_id", pa.int64()), ("term", pa.string()), *((n, pa.int32()) for n in ("position", "start_char", "end_char"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc_id, *t) for batch in batches for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["normal"]) for t in T.offsets_of(text.as_py() or ""))
        while part := list(islice(rows, ROWS_OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), kind)], schema=kind)

    normal = spread(docs.select(F.col("doc_id").cast("bigint"), text_col)).select("doc_id", T.normalize(F.col(text_col)).alias("normal"))
    return normal.mapInArrow(run, "doc_id bigint, term string, position int, start_char int, end_char int")


def term_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf)."""
    return token_stream(docs, text_col).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def sized_frequencies(docs: DataFrame, text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, doc_len), as the index stores them: scoring needs no other table by document. ``only`` (term, each once) leaves out all others before they are shuffled."""
    stream = _stream(docs, text_col)
    return (stream if only is None else stream.join(only, "term", "left_semi")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.any_value("doc_len").alias("doc_len"))


def postings(docs: DataFrame, text_col: str = "text", unique: bool = False) -> DataFrame:
    """(doc_id, term, tf, positions, doc_len). Documents are inverted where they are read; only rows that share a doc_id (none, if ``unique``) are shuffled to be added up."""
    if unique:
        return _inverted(docs, text_col)
    often = docs.groupBy(F.col("doc_id").alias("often")).count().where("count > 1").select("often")
    if often.isEmpty():
        return _inverted(docs, text_col)
    same = F.col("doc_id").eqNullSafe(F.col("often"))
    return _inverted(docs.join(often, same, "left_anti"), text_col).unionByName(gathered_postings(docs.join(often, same, "left_semi"), text_col))


def gathered_postings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same with a shuffle of all tokens, for what goes on with postings by document and term."""
    found = _stream(docs, text_col).groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.any_value("doc_len").alias("doc_len"))
    return found.select("doc_id", "term", F.size("positions").cast("bigint").alias("tf"), "positions", "doc_len")


def _inverted(docs: DataFrame, text_col: str) -> DataFrame:
    """Postings of each row by itself, ``ROWS_OUT`` at a time: no shuffle, no sort."""
    kind = pa.schema([("doc_id", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("positions", pa.list_(pa.int32())), ("doc_len", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        stem = lru_cache(1 << 16)(T.stem_word)
        for batch in batches:
            for doc_id, kept in zip(batch["doc_id"].to_pylist(), batch["kept"]):
                places: dict[str, list[int]] = {}
                for pos, word in enumerate(words := kept.as_py()):
                    places.setdefault(stem(word), []).append(pos)
                for term, at in places.items():
                    yield doc_id, term, len(at), at, len(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = each(batches)
        while part := list(islice(rows, ROWS_OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), kind)], schema=kind)

    kept = spread(docs.select(F.col("doc_id").cast("bigint"), text_col)).select("doc_id", T.tokens(T.normalize(F.col(text_col))).alias("kept"))
    return kept.mapInArrow(run, "doc_id bigint, term string, tf bigint, positions array<int>, doc_len bigint")


def doc_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, doc_len); documents without terms have 0. No shuffle."""
    return spread(docs.select("doc_id", text_col)).select("doc_id", F.size(T.tokens(T.normalize(F.col(text_col)))).cast("bigint").alias("doc_len"))


def doc_frequency(tf: DataFrame) -> DataFrame:
    """(term, df)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: (n_docs, avg_len)."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avg_len"))


def vocabulary(tf: DataFrame) -> DataFrame:
    return tf.select("term").distinct()


def live(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Postings of documents that aren't deleted."""
    return postings.join(tombstones.select("doc_id"), "doc_id", "left_anti")


def posting_gaps(tf: DataFrame) -> DataFrame:
    """(term, doc_id, gap): the delta encoding of each term's posting list."""
    before = F.lag("doc_id", 1, 0).over(Window.partitionBy("term").orderBy("doc_id"))
    return tf.select("term", "doc_id", (F.col("doc_id") - before).alias("gap"))


def vbyte_sizes(tf: DataFrame) -> DataFrame:
    """(term, postings, bytes): what the lists' gaps and frequencies take as variable bytes."""
    size = (vbyte_size(F.col("gap")) + vbyte_size(F.col("tf"))).cast("bigint")
    before = F.lag("doc_id", 1, 0).over(Window.partitionBy("term").orderBy("doc_id"))
    sized = tf.select("term", "tf", (F.col("doc_id") - before).alias("gap"))
    return sized.groupBy("term").agg(F.count("*").alias("postings"), F.sum(size).alias("bytes"))


def merge_postings(*parts: DataFrame) -> DataFrame:
    """Several segments' postings as one: frequencies added, positions joined and sorted."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    merged = union.select("doc_id", "term", "tf", "positions").groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    return merged.select("doc_id", "term", "tf", "positions")


def shard(doc_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(shards)).cast("int")
