"""The search engine: an index store and everything that answers a query from it."""

from __future__ import annotations

import time
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.functions.constants import ALPHA, BETA, GAMMA
from termforge.operators import pagerank, ranking, snippets, understanding
from termforge.plans import parser
from termforge.plans.cache import ResultCache
from termforge.sources.store import IndexStore


class HashEncoder:
    """Vectors without a model. Another encoder has the same two methods; its vectors are stored as documents are added."""

    def table(self, docs: DataFrame) -> DataFrame:
        """(doc_id, embedding) of (doc_id, text)."""
        return ranking.hash_embedding(docs)

    def vector(self, text: str) -> list[float]:
        return ranking.hash_vector(text)


class SearchEngine:
    """``add`` and ``delete`` change the index, ``search`` asks it, ``search_batch`` asks many queries in one job.

    All state but the cache is in the store: an engine opened on a folder goes on where another one stopped.
    """

    def __init__(self, spark: SparkSession, path: str, weights: tuple[float, float, float] = (ALPHA, BETA, GAMMA), encoder: Any = None, segment_docs: int | None = None):
        self.spark, self.weights, self.encoder = spark, weights, encoder or HashEncoder()
        self.store = IndexStore(spark, path, segment_docs, self.encoder.table)
        self.cache = ResultCache()

    def add(self, docs: DataFrame, links: DataFrame | None = None) -> None:
        """Index documents; with ``links`` (src, dst) PageRank is computed anew."""
        self.store.add(docs)
        self.store.merge_if_needed()
        if links is not None:
            self.store.set_scores(pagerank.pagerank_converged(links).select(F.col("node").alias("doc_id"), "score"))
        self.cache.invalidate_all()

    def delete(self, *doc_ids: int) -> None:
        self.store.delete(self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id bigint"))
        self.cache.invalidate_all()

    def set_weights(self, alpha: float, beta: float, gamma: float) -> tuple[float, float, float]:
        """Weights for later queries, made to add up to 1."""
        self.weights = ranking.normalized_weights(alpha, beta, gamma)
        return self.weights

    def stats(self) -> dict[str, Any]:
        corpus, terms = self.store.corpus(), self.store.postings().agg(F.count_distinct("term")).first()[0]
        return {"documents": corpus["n_docs"], "average_length": corpus["avg_len"], "terms": terms, "segments": len(self.store.segment_ids()), "cache": self.cache.stats()}

    def understand(self, query: str) -> dict[str, Any]:
        """Intent, corrections, the rewritten query and the expanded words."""
        state = self.store.manifest()
        return self._understand(query, self._known(query.lower().split(), [], state)[0], state)

    def _known(self, words: list[str], terms: list[str], state: dict) -> tuple[set[str], dict[str, int]]:
        """Which of the words are in the vocabulary, and in how many live documents each term is: in one job over the sorted files."""
        words = sorted({w for w in words if len(w) > 2})
        known = self.store.terms(state).where(F.col("term").isin(*words)).select("term", F.lit(-1).cast("bigint").alias("df")).distinct() if words else None
        counted = self.store.lookup(terms, state).groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df")) if terms else None
        both = known.unionByName(counted) if words and terms else known if words else counted
        rows = both.collect() if both is not None else []
        return {r["term"] for r in rows if r["df"] < 0}, {r["term"]: r["df"] for r in rows if r["df"] >= 0}

    def _understand(self, query: str, known: set[str], state: dict) -> dict[str, Any]:
        """The vocabulary is only gone through if a word isn't in it."""
        query = query.strip()
        words = query.lower().split()
        unknown, fixes = sorted({w for w in words if len(w) > 2 and w not in known}), {}
        if unknown:
            asked = self.spark.createDataFrame([(w,) for w in unknown], "word string")
            fixes = {r["word"]: r["correction"] for r in understanding.nearest_terms(asked, self.store.terms(state).select("term"), few=True).collect()}
        rewritten = query
        for w in dict.fromkeys(words):
            rewritten = rewritten.replace(w, fixes.get(w, w))
        return {
            "original": query, "rewritten": rewritten, "intent": understanding.intent_of(query), "corrections": fixes,
            "expanded_terms": understanding.expand_words(rewritten.lower().split()), "confidence": 0.6 if fixes else 0.8,
        }

    def rank(self, query: str, terms: list[str], df: dict[str, int], k: int, clicked: list[int] | None, config: dict[str, float], state: dict) -> DataFrame:
        """The k best candidates: documents with any term of ``df``; only ``terms`` give a lexical score."""
        counts = Counter(terms)
        postings = self.store.lookup([*df], state).select("doc_id", "term", "tf", "doc_len")
        lexical = ranking.score_one(postings, {t: (counts[t], n) for t, n in df.items()}, self.store.corpus(state), config["k1"], config["b"])
        semantic = ranking.cosine_to(self.store.vectors(state), self.encoder.vector(query)) if config["gamma"] else None
        history = self.spark.createDataFrame([(d,) for d in clicked], "doc_id bigint") if clicked else None
        prior = self.store.scores(state) if config["beta"] else None
        scored = ranking.hybrid(lexical, prior, semantic, history, config["alpha"], config["beta"], config["gamma"], config["click_boost"])
        return ranking.top_k(scored, k)

    def search(
        self, query: str, k: int = 10, clicked: list[int] | None = None, weights: tuple[float, float, float] | None = None, use_cache: bool = True, config: dict[str, float] | None = None,
    ) -> dict[str, Any]:
        """Results with scores and snippets, what was understood, the settings used, and the time of each stage in ms.

        "retrieval" looks up words and counts the postings of the query's terms, "ranking" scores and reads the k best. ``config`` sets some of
        alpha, beta, gamma, k1, b and click_boost for this query.
        """
        if not query.strip():
            raise ValueError("the query is empty")
        if not 1 <= k <= 100:
            raise ValueError("k must be from 1 to 100")
        begin = last = time.perf_counter()
        timing: dict[str, float] = {}

        def lap(stage: str) -> None:
            nonlocal last
            now = time.perf_counter()
            timing[f"{stage}_ms"] = round(timing.get(f"{stage}_ms", 0.0) + (now - last) * 1000, 2)
            last = now

        used = ranking.weights_from(dict(zip(("alpha", "beta", "gamma"), weights or self.weights)) | (config or {}))
        key = (query, k, tuple(sorted(clicked or ())), tuple(sorted(used.items())))
        if use_cache and (held := self.cache.get(key)) is not None:
            held["from_cache"] = True
            held["timing"]["total_ms"] = round((time.perf_counter() - begin) * 1000, 2)
            return held
        raw, state = query.lower().split(), self.store.manifest()  # all of a search sees one state
        hoped = sorted({*T.terms_of(query), *T.terms_of(" ".join(understanding.expand_words(raw)))})  # right unless a word is corrected
        known, df = self._known(raw, hoped, state)
        lap("retrieval")
        info = self._understand(query, known, state)
        lap("understanding")
        words = parser.parse(info["rewritten"]).all_terms()
        terms, more = T.terms_of(info["rewritten"]), T.terms_of(" ".join(info["expanded_terms"]))
        lap("parse")
        if new := sorted({*terms, *more} - set(hoped)):
            df |= self._known([], new, state)[1]
            lap("retrieval")
        df = {t: n for t, n in df.items() if t in {*terms, *more}}
        rows = self.rank(query, terms, df, k, clicked, used, state).collect() if df else []  # k at most, in order
        about = {r["doc_id"]: r for r in self.store.meta(state).where(F.col("doc_id").isin(*(r["doc_id"] for r in rows))).collect()} if rows else {}
        rows = [r.asDict() | about[r["doc_id"]].asDict() for r in rows if r["doc_id"] in about]
        lap("ranking")
        results = [
            {
                "doc_id": r["doc_id"], "url": r["url"], "title": r["title"], "snippet": snippets.snippet_of(r["content_preview"], words), "score": round(r["score"], 4),
                "scores": {n: round(r[n], 4) for n in ("bm25", "pagerank", "semantic")} | {"final": round(r["score"], 4)},
            }
            for r in rows
        ]
        lap("snippet")
        timing["total_ms"] = round((last - begin) * 1000, 2)
        info["expanded_terms"] = info["expanded_terms"][:10]
        response = {"results": results, "total_results": len(results), "query_info": info, "timing": timing, "config_used": used, "from_cache": False}
        if use_cache:
            self.cache.put(key, response)
        return response

    def search_strict(self, query: str) -> DataFrame:
        """(doc_id) that satisfy the query's operators, phrases and fields (title, url)."""
        stream = self.store.postings().select("doc_id", F.explode("positions").alias("pos"), "term")
        return parser.evaluate(parser.parse(query), stream, self.store.meta())

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, score) for a table (query_id, text) of any size, by BM25."""
        asked = ranking.query_terms(queries, "query_id", "text")
        state = self.store.manifest()
        corpus = self.spark.createDataFrame([self.store.corpus(state)], "n_docs bigint, avg_len double")
        scored = ranking.score_bm25(self.store.postings(state).select("doc_id", "term", "tf", "doc_len"), None, corpus, asked, small=False)
        return ranking.top_k_per_query(scored, k)
