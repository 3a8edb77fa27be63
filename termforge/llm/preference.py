"""A quality classifier from preference pairs (Bradley-Terry).

A document's score is a weighted sum of its features: its distinct words, hashed, and
bins of its surface statistics. The chance that one document is preferred to
another is the logistic function of their difference in score. Weights are learnt from pairs
of a preferred document (good quality, not toxic) and another one, by the logistic loss on
the feature differences, with an L1 penalty that leaves most words without
a weight. All labelled documents are learnt from. They are spread by their doc_id's hash over shards of about
``SHARD_ROWS``; a task fits one shard on all its pairs, and the weights are the mean over the shards that have both
sides (up to ``SHARD_ROWS`` there is one shard, and pairs of documents in different shards aren't compared). The threshold
is a quantile of all labelled documents' scores, counted in steps of 1 / ``STEPS_OF_SCORE``: the one that
parts the two sides best, in the middle of those that are nearly as good.

Defined results: a null or wordless text is rejected, with the null score; equal
texts score alike; with labels on one side only (or none) every text with words scores 0 and is kept, and
where no threshold parts the labelled documents better than chance every text with words is kept.
A score equal to the threshold is rejected. Features are those of whole texts however long.
Rows, repeated or without doc_id, are scored one by one; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import labelled
from termforge.llm.common import cut, identified, table
from termforge.llm.stats import NAMES, text_stats

WORD_BITS, STAT_BINS = 18, 16
#: Labelled documents that are fitted together, about; steps, step size, documents that must have a feature.
SHARD_ROWS, STEPS, RATE, LEAST_DOCS = 20_000, 300, 0.05, 8
#: Points of the grid a unit of score has: for the sums over all pairs, for the threshold, and for the mean of weights.
GRID, STEPS_OF_SCORE, WEIGHT_STEPS = 64, 4096, 1 << 30
#: The L1 penalty, in standard errors of a feature's gradient if it meant nothing.
PENALTY = 3.5
#: Thresholds whose share of rightly placed documents is that close to the best count as equal.
NEARLY = 0.005
#: The upper end of each statistic's bins.
_SPAN = np.array([10.0, 12.0, 1.0, 0.5, 1.0, 0.5, 1.0, 1.0, 0.5, 1.0])
FEATURES = (1 << WORD_BITS) + STAT_BINS * len(NAMES)


def features(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's feature numbers, ascending, and whether it has words."""
    x, distinct = text_stats(texts)
    bins = np.clip((x / _SPAN * STAT_BINS).astype(np.int64), 0, STAT_BINS - 1)
    bins += (1 << WORD_BITS) + np.arange(len(NAMES)) * STAT_BINS
    shift = np.uint64(64 - WORD_BITS)
    # hashes are sorted, so their leading bits are too
    words = [(d >> shift).astype(np.int64) for d in distinct]
    words = [w[np.append(True, w[1:] != w[:-1])] if len(w) else w for w in words]
    return [np.concatenate([w, b]) for w, b in zip(words, bins)], x[:, 0] > 0


@dataclass
class Ranker:
    """Weights by feature number, and the threshold with the quantile it was taken at."""

    weights: np.ndarray
    threshold: float
    quantile: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        found, wordy = features(texts)
        return np.array([self.weights[f].sum() if ok else np.nan for f, ok in zip(found, wordy)], dtype=np.float64)


def all_pairs(s: np.ndarray, good: np.ndarray) -> np.ndarray:
    """For each document the chances, summed over all of the other side, that its pair is placed wrongly by the scores ``s``.

    Scores are spread over the two nearest points of a grid, so the sums are convolutions; the logistic function is linear between points.
    """
    low = s.min()
    place = (s - low) * GRID
    cell = place.astype(np.int64)
    part, size = place - cell, int(cell.max()) + 2
    wrong = 1 / (1 + np.exp(np.clip(np.arange(1 - size, size) / GRID, -50, 50)))  # by how much the preferred one is ahead
    out = np.empty(len(s))
    for side, kernel in ((good, wrong), (~good, wrong[::-1])):
        other = np.bincount(cell[~side], 1 - part[~side], size) + np.bincount(cell[~side] + 1, part[~side], size)
        sums = np.convolve(other, kernel)[size - 1 : 2 * size - 1]
        out[side] = sums[cell[side]] * (1 - part[side]) + sums[cell[side] + 1] * part[side]
    return out


def fit_weights(found: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, Bradley-Terry weights other than 0) for documents with features ``found``, preferred where ``good``; both sides must be there."""
    cols = np.concatenate(found)
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
    common = np.bincount(cols, minlength=FEATURES) >= min(LEAST_DOCS, max(1, len(found) // 10))
    names = np.flatnonzero(common)
    number = np.full(FEATURES, -1, dtype=np.int32)
    number[names] = np.arange(len(names))
    held = common[cols]
    rows, cols = rows[held], number[cols[held]]
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    yes, no = int(good.sum()), int((~good).sum())
    share = np.bincount(cols, minlength=len(names)) / len(found)
    error = np.sqrt(share * (1 - share) * (1 / yes + 1 / no))
    for step in range(1, STEPS + 1):
        wrong = all_pairs(np.bincount(rows, w[cols], len(found)), good) / yes / no
        grad = np.bincount(cols, np.where(good, -wrong, wrong)[rows], len(names))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = RATE * (1 - step / (STEPS + 1))
        scale = np.sqrt(v / (1 - 0.99**step)) + 1e-4
        w -= rate * m / (1 - 0.9**step) / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * PENALTY * wrong[good].sum() * error / scale)
    return names[w != 0], w[w != 0]


def _features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found, wordy = features(pdf["text"].where(pdf["text"].notna(), None).tolist())
        yield pdf.drop(columns="text").assign(found=[f.astype(np.int32) for f in found])[wordy]


def _fit_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    found, good = pdf["found"].tolist(), pdf["good"].to_numpy().astype(bool)
    del pdf
    if good.all() or not good.any():
        return pd.DataFrame({"name": np.zeros(0, np.int32), "steps": np.zeros(0, np.int64)})
    order = sorted(range(len(found)), key=lambda k: (found[k].tobytes(), good[k]))  # the same weights for any order of rows
    names, w = fit_weights([found[k] for k in order], good[order])
    # the row numbered FEATURES counts the shard
    return pd.DataFrame({"name": np.append(names, FEATURES).astype(np.int32), "steps": np.append(np.rint(w * WEIGHT_STEPS), 1).astype(np.int64)})


def _score_steps(weights: np.ndarray):
    held = np.flatnonzero(weights)
    values = weights[held]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = np.zeros(FEATURES)
        whole[held] = values
        for pdf in batches:
            s = np.array([whole[f].sum() for f in pdf["found"]], dtype=np.float64)
            yield pd.DataFrame({"step": np.ceil(s * STEPS_OF_SCORE).astype(np.int64), "good": pdf["good"]})

    return run


def best_threshold(step: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """(threshold, quantile) for the numbers of preferred and other documents at each ascending ``step`` of score; -inf if none parts the sides."""
    below = (np.cumsum(no) / no.sum() - np.cumsum(yes) / yes.sum())[:-1]
    if not len(below) or below.max() <= 0:
        return -np.inf, 0.0
    fine = step[:-1][below >= below.max() - NEARLY]
    middle = int(fine[0] + fine[-1]) // 2
    return middle / STEPS_OF_SCORE, float((yes + no)[step <= middle].sum() / (yes + no).sum())


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, good, found) of all labelled documents that have words."""
    known = labelled.marks(labels).select("__id", F.expr("quality > 0 AND toxic = 0").alias("good"))
    texts = identified(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    if known.count() <= labelled.BROADCAST_ROWS:
        both = texts.join(F.broadcast(known), texts["doc_id"] == known["__id"]).select("doc_id", "text", "good")
        return both.mapInPandas(_features_of, "doc_id bigint, good boolean, found array<int>")
    made = texts.mapInPandas(_features_of, "doc_id bigint, found array<int>")
    return made.join(known, made["doc_id"] == known["__id"]).select("doc_id", "good", "found")


def learn(docs: DataFrame, labels: DataFrame) -> Ranker:
    """The ranker, fitted on all labelled documents."""
    sides = cut(labelled_features(docs, labels))
    n, yes = sides.agg(F.count("*"), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0))).first()
    weights = np.zeros(FEATURES)
    if yes in (0, n):
        return Ranker(weights, -np.inf, 0.0)
    shard = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(math.ceil(n / SHARD_ROWS)))
    fits = sides.groupBy(shard.alias("shard")).applyInPandas(_fit_shard, "name int, steps bigint")
    total = {r["name"]: r["steps"] for r in fits.groupBy("name").agg(F.sum("steps").alias("steps")).collect()}  # whole numbers, so their order doesn't matter
    fitted = total.pop(FEATURES, 0)
    if total:
        weights[list(total)] = np.array(list(total.values())) / (fitted * WEIGHT_STEPS)
    counts = sides.mapInPandas(_score_steps(weights), "step bigint, good boolean").groupBy("step").agg(F.count_if("good").alias("yes"), F.count_if(~F.col("good")).alias("no")).toPandas().sort_values("step")
    return Ranker(weights, *best_threshold(*(counts[c].to_numpy() for c in ("step", "yes", "no"))))


def scorer(ranker: Ranker):
    """A pandas UDF from text to score."""
    held = np.flatnonzero(ranker.weights)
    values, threshold, quantile = ranker.weights[held], ranker.threshold, ranker.quantile

    @F.pandas_udf("double")
    def preference_score(text: pd.Series) -> pd.Series:
        weights = np.zeros(FEATURES)
        weights[held] = values
        return pd.Series(Ranker(weights, threshold, quantile).score(text.where(text.notna(), None).tolist()))

    return preference_score


def score_documents(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score, keep) for every row of ``docs``."""
    scored = identified(docs).select("doc_id", F.nanvl(scorer(ranker)("text"), F.lit(None).cast("double")).alias("score"))
    keep = F.coalesce(F.col("score") > ranker.threshold, F.lit(False))
    return scored.select("doc_id", F.round("score", 6).alias("score"), keep.alias("keep"))


def keep_preferred(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score above the threshold, with all their columns."""
    score = F.nanvl(scorer(ranker)(F.col(text_col).cast("string")), F.lit(None).cast("double"))
    return docs.where(score > ranker.threshold)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
