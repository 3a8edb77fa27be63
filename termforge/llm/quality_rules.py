"""Gradient-boosted trees over document statistics, as quality rules.

Trees are grown on quantile bins with the logistic loss, on a bounded sample of labelled
documents, and flattened into numpy node arrays: a batch walks all rows of a tree one
level at a time. For chosen statistics the score may only rise or only fall
(``MONOTONE``): a split that breaks this is not taken, and the children's values are
bounded by the middle of their parent's split.

Defined results: a null or wordless text scores 0 and is rejected; equal texts score
alike; with labels of one class only (or none) nothing can be learnt and every text with
words scores 1. Of splits that gain the same the first statistic and bin is taken; a score equal to ``CUT`` is kept. Statistics are those of
whole texts however long. Rows, repeated or without doc_id, are scored one by one; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm.common import identified, table
from termforge.llm.labelled import TRAIN_ROWS, labelled_documents
from termforge.llm.stats import NAMES, text_stats

#: +1: the score never falls as the statistic grows; -1: it never rises.
MONOTONE = {"distinct_words": 1, "top_word": -1, "symbols": -1, "exclaims": -1, "pipes": -1, "repeated_lines": -1}
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 60, 3, 0.2, 64, 5, 1.0
#: Documents with a lower probability of being good are rejected.
CUT = 0.5


@dataclass
class Forest:
    """Node arrays of all trees, each of ``2 ** (DEPTH + 1) - 1`` nodes in heap order."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of being good, for each row of statistics."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node]
        return 1 / (1 + np.exp(-total))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, signs: np.ndarray):
    """One tree on the gradients ``g`` and curvatures ``h``: (feature, threshold, value)."""
    size = 2 ** (DEPTH + 1) - 1
    feature, threshold, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
    low, high = np.full(size, -np.inf), np.full(size, np.inf)
    node = np.zeros(len(g), dtype=np.int64)
    value[0] = -g.sum() / (h.sum() + RIDGE)
    for depth in range(DEPTH):
        for at in range(2**depth - 1, 2 ** (depth + 1) - 1):
            rows = np.flatnonzero(node == at)
            best = (1e-6, None)
            if len(rows) >= 2 * LEAST_LEAF:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, edges in enumerate(cuts):
                    b = binned[rows, f]
                    left_g, left_h, left_n = (np.cumsum(np.bincount(b, w, BINS + 1))[: len(edges)] for w in (g[rows], h[rows], None))
                    with np.errstate(all="ignore"):
                        vl = np.clip(-left_g / (left_h + RIDGE), low[at], high[at])
                        vr = np.clip(-(gs - left_g) / (hs - left_h + RIDGE), low[at], high[at])
                    gain = -(left_g * vl + (left_h + RIDGE) * vl**2 / 2) - ((gs - left_g) * vr + (hs - left_h + RIDGE) * vr**2 / 2)
                    gain += gs * value[at] + (hs + RIDGE) * value[at] ** 2 / 2
                    gain[(left_n < LEAST_LEAF) | (len(rows) - left_n < LEAST_LEAF) | ((vr - vl) * signs[f] < 0)] = -1
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), (f, k, float(vl[k]), float(vr[k])))
            left, right = 2 * at + 1, 2 * at + 2
            if best[1] is None:  # all rows go left, at the same value
                value[left] = value[right] = value[at]
                low[left], high[left] = low[at], high[at]
                node[rows] = left
                continue
            f, k, vl, vr = best[1]
            feature[at], threshold[at], value[left], value[right] = f, cuts[f][k], vl, vr
            low[left], high[left], low[right], high[right] = low[at], high[at], low[at], high[at]
            if signs[f]:
                (high if signs[f] > 0 else low)[left] = (vl + vr) / 2
                (low if signs[f] > 0 else high)[right] = (vl + vr) / 2
            node[rows] = np.where(binned[rows, f] > k, right, left)
    return feature, threshold, value, value[node]


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: dict[str, int] = MONOTONE, names: list[str] = NAMES) -> Forest | None:
    """Boosted trees for the 0/1 target ``y``; None with fewer than two classes."""
    if len(np.unique(y)) < 2:
        return None
    signs = np.array([monotone.get(n, 0) for n in names])
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        feature, threshold, value, step = _grow(binned, cuts, p - y, p * (1 - p), signs)
        total += RATE * step
        trees.append((feature, threshold, RATE * value))
    return Forest(base, *(np.stack(part) for part in zip(*trees)))


def _stats_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        x, _ = text_stats(pdf["text"].where(pdf["text"].notna(), None).tolist())
        yield pd.DataFrame(x, columns=NAMES).assign(quality=pdf["quality"].to_numpy())


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Forest | None:
    """The forest for ``quality``, fitted on at most ``most`` labelled documents."""
    sample = labelled_documents(docs, labels, most)
    schema = ", ".join(f"{n} double" for n in NAMES) + ", quality int"
    pdf = sample.select("text", "quality").mapInPandas(_stats_of, schema).toPandas()
    pdf = pdf.sort_values([*NAMES, "quality"], ignore_index=True)  # the same forest for any order of rows
    return fit_forest(pdf[NAMES].to_numpy(), (pdf["quality"] > 0).to_numpy(dtype=float))


def scorer(forest: Forest | None):
    """A pandas UDF from text to score."""

    @F.pandas_udf("double")
    def quality_score(text: pd.Series) -> pd.Series:
        x, _ = text_stats(text.where(text.notna(), None).tolist())
        score = forest.score(x) if forest else np.ones(len(x))
        return pd.Series(np.where(x[:, 0] > 0, score, 0.0))

    return quality_score


def score_documents(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """(doc_id, score, keep) for every row of ``docs``."""
    scored = identified(docs).select("doc_id", scorer(forest)("text").alias("score"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= CUT).alias("keep"))


def keep_good(docs: DataFrame, forest: Forest | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return docs.where(scorer(forest)(F.col(text_col).cast("string")) >= CUT)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict for all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
