"""The index on disk: immutable Parquet segments, tombstones, document tables, and a manifest that names what counts.

    postings/segment_id=.../   doc_id, term, tf, positions, doc_len, sorted by term
    terms/segment_id=.../      term, df: what the segment was written with
    lengths/segment_id=.../    doc_id, doc_len
    meta/segment_id=.../       doc_id, url, title, content_preview, crawled_at
    vectors/segment_id=.../    doc_id, embedding
    tombstones/part=.../       doc_id, segment_id up to which it is gone
    scores/part=.../           doc_id, score
    manifest/<number>.json     the segments, tombstones and scores of a state; the greatest number counts

A change writes its tables first and then a manifest under a name of its own, which one rename puts in place. A
write that ends halfway leaves the former state, and what it wrote is nowhere named; a reader sees a merge, or a
document's replacement, wholly or not at all. Two writers that start from one state can't both succeed.
A term lookup is a pushed-down filter on files sorted by term. A document that is added again replaces its former self.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termforge.functions.constants import MERGE_FACTOR
from termforge.operators import index
from termforge.sources.shared import new_folder, remove

SCHEMAS = {
    "postings": "doc_id bigint, term string, tf bigint, positions array<int>, doc_len bigint, segment_id bigint",
    "terms": "term string, df bigint, segment_id bigint",
    "lengths": "doc_id bigint, doc_len bigint, segment_id bigint",
    "meta": "doc_id bigint, url string, title string, content_preview string, crawled_at timestamp, segment_id bigint",
    "vectors": "doc_id bigint, embedding array<double>, segment_id bigint",
    "tombstones": "doc_id bigint, before bigint, part bigint",
    "scores": "doc_id bigint, score double, part bigint",
}
TABLES = ("postings", "terms", "meta", "vectors", "lengths")
DOCUMENT = "doc_id bigint, url string, title string, content string, crawled_at timestamp"
EMPTY = {"version": 0, "next": 0, "segments": [], "tombstones": [], "scores": None}
_log = logging.getLogger(__name__)
#: Documents that one task numbers when segments have a size.
_NUMBERED = 100_000


class IndexStore:
    """``segment_docs`` bounds the documents of a segment as it is added; without it every ``add`` makes one. ``encode`` maps (doc_id, text) to (doc_id, embedding)."""

    def __init__(self, spark: SparkSession, path: str, segment_docs: int | None = None, encode: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.segment_docs, self.encode = spark, path.rstrip("/"), segment_docs, encode
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._stats: tuple[int, dict[str, float]] | None = None

    # --- the manifest ---------------------------------------------------------------------------

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def manifest(self) -> dict:
        """The present state. A manifest that can't be read is passed over, with a warning, for the one before."""
        if not self._fs.exists(self._at("manifest")):
            return dict(EMPTY)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifest"))]
        for number in sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True):
            try:
                stream = self._fs.open(self._at(f"manifest/{number}.json"))
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                return json.loads(text)
            except Exception as e:
                _log.warning("manifest %s of %s can't be read, the one before counts: %s", number, self.path, e)
        return dict(EMPTY)

    def _publish(self, old: dict, **changes) -> dict:
        new = old | changes | {"version": old["version"] + 1}
        to, by = self._at(f"manifest/{new['version']}.json"), self._at(f"manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(by, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(by, to):
            raise RuntimeError(f"{self.path} was changed by another writer; nothing was changed by this one")
        return new

    def _parts(self, name: str, column: str, numbers: list[int], schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col(column).isin(*numbers))

    def _read(self, name: str, state: dict | None = None) -> DataFrame:
        return self._parts(name, "segment_id", (state or self.manifest())["segments"], SCHEMAS[name])

    def segment_ids(self) -> list[int]:
        return sorted(self.manifest()["segments"])

    # --- changes --------------------------------------------------------------------------------

    def _numbered(self, docs: DataFrame, first: int) -> tuple[DataFrame, list[int]]:
        """With the segment of each document: ``segment_docs`` to each but the last, by hash and doc_id."""
        n = docs.count()
        if not self.segment_docs or n <= self.segment_docs:
            return docs.withColumn("segment_id", F.lit(first).cast("bigint")), [first] if n else []
        ids = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // _NUMBERED))).alias("bucket"))
        sizes = ids.groupBy("bucket").count()
        before = sizes.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("before"))  # a row for each 100,000 documents
        nth = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")) - 1
        placed = ids.withColumn("nth", nth).join(before, "bucket").select("doc_id", (F.floor((F.col("nth") + F.col("before")) / self.segment_docs) + first).cast("bigint").alias("segment_id"))
        return docs.join(placed, "doc_id"), list(range(first, first + -(-n // self.segment_docs)))

    def add(self, docs: DataFrame) -> int | None:
        """Write ``docs`` (doc_id, url, title, content, crawled_at) as one or more new segments; the last one's number, None without documents.

        Of rows that share a doc_id the one crawled last counts, of these the one with the least hash. Rows without doc_id aren't indexed.
        """
        state, folder = self.manifest(), new_folder(self.spark)
        latest = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("crawled_at"), F.xxhash64("url", "title", "content"))
        once = docs.where("doc_id IS NOT NULL").select("doc_id", "url", "title", "content", "crawled_at").withColumn("nth", F.row_number().over(latest)).where("nth = 1").drop("nth")
        once.write.parquet(folder)  # one choice for all tables
        once = self.spark.read.schema(once.schema).parquet(folder)
        once, numbers = self._numbered(once, state["next"])
        if numbers:
            gone = once.select("doc_id") if state["segments"] else None
            by, first = once.select("doc_id", "segment_id"), F.lit(numbers[0]).cast("bigint")
            number = lambda df: df.join(by, "doc_id") if len(numbers) > 1 else df.withColumn("segment_id", first)
            found = index.postings(once, "content", unique=True)
            vectors = self.encode(once.select("doc_id", F.col("content").alias("text"))) if self.encode else self.spark.createDataFrame([], "doc_id bigint, embedding array<double>")
            tables = {
                "postings": number(found),
                "meta": once.select("doc_id", "url", "title", F.substring("content", 1, 200).alias("content_preview"), "crawled_at", "segment_id"),
                "vectors": number(vectors),
            }
            self._write(tables)
            self._publish(state, next=numbers[-1] + 1, segments=[*state["segments"], *numbers], tombstones=state["tombstones"] + self._bury(state, gone, numbers[0]))
        remove(self.spark, folder)
        return numbers[-1] if numbers else None

    def _write(self, tables: dict[str, DataFrame]) -> None:
        """All tables of new segments; the terms, and the lengths of documents (doc_id, segment_id), are read off the postings once these are written."""

        def save(name: str, df: DataFrame, *order: str) -> None:
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            df = df.select(*columns)
            if order:  # by hash, as ranges would have to be sampled first; a term that many documents have is split where it is too large
                df = df.hint("rebalance", "segment_id", "term").sortWithinPartitions("segment_id", *order)
            df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("segment_id").parquet(f"{self.path}/{name}")

        save("postings", tables["postings"], "term", "doc_id")
        save("meta", tables["meta"])
        save("vectors", tables["vectors"])
        numbers = [r[0] for r in tables["meta"].select("segment_id").distinct().collect()]  # a few
        written = self._parts("postings", "segment_id", numbers, SCHEMAS["postings"])
        save("terms", written.groupBy("segment_id", "term").agg(F.count("*").alias("df")), "term")
        sized = written.groupBy("doc_id").agg(F.any_value("doc_len").alias("doc_len"))
        save("lengths", tables["meta"].select("doc_id", "segment_id").join(sized, "doc_id", "left").withColumn("doc_len", F.coalesce("doc_len", F.lit(0).cast("bigint"))))

    def _bury(self, state: dict, doc_ids: DataFrame | None, before: int) -> list[int]:
        """Write tombstones and give their part's number; nothing counts until it is published."""
        if doc_ids is None:
            return []
        part = max([-1, *state["tombstones"]]) + 1
        doc_ids.select("doc_id", F.lit(before).cast("bigint").alias("before")).write.mode("overwrite").parquet(f"{self.path}/tombstones/part={part}")
        return [part]

    def delete(self, doc_ids: DataFrame) -> None:
        """Documents are gone from all segments there are now."""
        state = self.manifest()
        self._publish(state, tombstones=state["tombstones"] + self._bury(state, doc_ids, state["next"]))

    def set_scores(self, scores: DataFrame) -> None:
        """Keep (doc_id, score), PageRank or another prior, in place of the former ones."""
        state = self.manifest()
        part = -1 if state["scores"] is None else state["scores"]
        scores.select("doc_id", "score").write.mode("overwrite").parquet(f"{self.path}/scores/part={part + 1}")
        self._publish(state, scores=part + 1)

    def merge_if_needed(self, factor: int = MERGE_FACTOR) -> int | None:
        return self.merge_smallest() if len(self.segment_ids()) >= factor else None

    def merge_smallest(self) -> int | None:
        """Merge the two smallest segments, leaving out what is deleted; the new number, or None."""
        small = [r["segment_id"] for r in self.segments().orderBy("num_docs", "segment_id").limit(2).collect()]
        return self._merge(small) if len(small) == 2 else None

    def _merge(self, numbers: list[int]) -> int:
        """The live rows as one segment. A live document is in one segment only, so nothing has to be added up; tombstones that no segment needs any more go."""
        state = self.manifest()
        number = state["next"]
        live = lambda name: self._live(self._parts(name, "segment_id", numbers, SCHEMAS[name]), state).withColumn("segment_id", F.lit(number).cast("bigint"))
        self._write({name: live(name) for name in ("postings", "meta", "vectors")})
        left = [*(s for s in state["segments"] if s not in numbers), number]
        needed = self.tombstones(state).where(F.col("before") > min(left))
        part = max([-1, *state["tombstones"]]) + 1
        if state["tombstones"]:
            needed.write.mode("overwrite").parquet(f"{self.path}/tombstones/part={part}")
        self._publish(state, next=number + 1, segments=left, tombstones=[part] if state["tombstones"] else [])
        return number

    def sweep(self) -> None:
        """Delete what no manifest names and all manifests but the present one, once no reader of an older state is left."""
        state = self.manifest()
        keep = {name: {f"segment_id={k}" for k in state["segments"]} for name in TABLES}
        keep |= {"tombstones": {f"part={k}" for k in state["tombstones"]}, "scores": {f"part={state['scores']}"}, "manifest": {f"{state['version']}.json"}}
        for name, wanted in keep.items():
            for s in self._fs.listStatus(self._at(name)) if self._fs.exists(self._at(name)) else ():
                if s.getPath().getName() not in wanted | {"_SUCCESS"}:
                    self._fs.delete(s.getPath(), True)

    # --- reading --------------------------------------------------------------------------------

    def tombstones(self, state: dict | None = None) -> DataFrame:
        parts = (state or self.manifest())["tombstones"]
        return self._parts("tombstones", "part", parts, SCHEMAS["tombstones"]).groupBy("doc_id").agg(F.max("before").alias("before"))

    def _live(self, df: DataFrame, state: dict) -> DataFrame:
        if not state["tombstones"]:
            return df
        gone = self.tombstones(state).withColumnRenamed("doc_id", "gone_id")
        return df.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("segment_id") < F.col("before")), "left_anti")

    def _table(self, name: str, state: dict | None = None) -> DataFrame:
        state = state or self.manifest()
        return self._live(self._read(name, state), state)

    def postings(self, state: dict | None = None) -> DataFrame:
        """Of the present state, as all that follows; or of a state that ``manifest`` gave before."""
        return self._table("postings", state)

    def lookup(self, terms: list[str], state: dict | None = None) -> DataFrame:
        """Live postings of some terms: the filter reaches the sorted files."""
        state = state or self.manifest()
        return self._live(self._read("postings", state).where(F.col("term").isin(*terms)), state)

    def terms(self, state: dict | None = None) -> DataFrame:
        """(term, df) by segment; deleted documents count until a merge."""
        return self._read("terms", state)

    def lengths(self, state: dict | None = None) -> DataFrame:
        return self._table("lengths", state)

    def meta(self, state: dict | None = None) -> DataFrame:
        return self._table("meta", state)

    def vectors(self, state: dict | None = None) -> DataFrame:
        return self._table("vectors", state).select("doc_id", "embedding")

    def scores(self, state: dict | None = None) -> DataFrame | None:
        part = (state or self.manifest())["scores"]
        return None if part is None else self._parts("scores", "part", [part], SCHEMAS["scores"]).select("doc_id", "score")

    def corpus(self, state: dict | None = None) -> dict[str, float]:
        """n_docs and avg_len of what is live, counted once for each state."""
        state = state or self.manifest()
        if self._stats is None or self._stats[0] != state["version"]:
            self._stats = state["version"], index.corpus_stats(self.lengths(state)).first().asDict()
        return self._stats[1]

    def segments(self) -> DataFrame:
        """(segment_id, num_docs, num_terms) as written, tombstones not considered."""
        state = self.manifest()
        docs = self._read("lengths", state).groupBy("segment_id").agg(F.count("*").alias("num_docs"))
        terms = self._read("terms", state).groupBy("segment_id").agg(F.count("*").alias("num_terms"))
        return docs.join(terms, "segment_id", "left").select("segment_id", "num_docs", F.coalesce("num_terms", F.lit(0)).alias("num_terms"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("doc_id", "url")) -> DataFrame:
    """``new`` and the rows of ``old`` that share no key with it; each key is unique by itself."""
    for key in keys:
        old = old.join(new.select(key), key, "left_anti").select(*new.columns)
    return old.unionByName(new)
