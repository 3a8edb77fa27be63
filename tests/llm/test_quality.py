"""The two trained filters: boosted rules and the preference ranker."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.llm import labelled, preference, quality_rules
from termforge.llm.common import word_hashes
from termforge.llm.labelled import labelled_documents
from termforge.llm.stats import NAMES, text_stats

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def split(spark):
    """Labelled documents, half to learn from and half held out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.where("pmod(xxhash64(doc_id), 2) = 0").join(docs, "doc_id").toPandas()
    return docs, labels.where("pmod(xxhash64(doc_id), 2) = 1"), held


def walk(forest, x):
    """A row's score, a node at a time."""
    total = forest.base
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
        node = 0
        while 2 * node + 1 < len(value):
            node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
        total += value[node]
    return 1 / (1 + np.exp(-total))


def test_statistics_by_hand():
    x, distinct = text_stats(["One two, two! 12\nsame\nsame", None, "", "ÄÄ"])
    s = dict(zip(NAMES, x[0]))
    assert s["log_words"] == pytest.approx(np.log1p(6)) and s["distinct_words"] == pytest.approx(4 / 6) and s["repeated_lines"] == pytest.approx(1 / 3)
    assert s["top_word"] == 2 / 6 and s["exclaims"] == 1 / 6 and len(distinct[0]) == 4 and not x[1].any() and not x[2].any() and x[3, 0] > 0


def test_word_hashes_depend_on_the_word_only():
    a, stops = word_hashes(["Red fish, blue fish", "", "fish"])
    assert a[1] == a[3] == a[4] and len(set(a.tolist())) == 3 and stops.tolist() == [4, 4, 5]


def test_flat_trees_are_the_trees_and_monotonic():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(NAMES)))
    chance = 1 / (1 + np.exp(-(6 * x[:, 2] - 5 * x[:, 4] * x[:, 5] - 2 + np.sin(20 * x[:, 5]))))
    forest = quality_rules.fit_forest(x, (rng.random(3000) < chance).astype(float))
    flat = forest.score(x[:200])
    assert flat == pytest.approx([walk(forest, r) for r in x[:200]])
    for name, sign in quality_rules.MONOTONE.items():
        grid = np.repeat(rng.random((50, 1, len(NAMES))), 40, axis=1)
        grid[:, :, NAMES.index(name)] = np.linspace(0, 1, 40)
        steps = np.diff(forest.score(grid.reshape(-1, len(NAMES))).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12


def test_rules_on_held_out_labels(split):
    docs, train, held = split
    forest = quality_rules.learn(docs, train)
    x, _ = text_stats(held["text"].tolist())
    keep = forest.score(x) >= quality_rules.CUT
    good = (held["quality"] > 0).to_numpy()
    assert keep[good].mean() > 0.95 and (~keep[~good]).mean() > 0.85


def test_ranker_on_held_out_labels(split):
    docs, train, held = split
    ranker = preference.learn(docs, train)
    keep = ranker.score(held["text"].tolist()) > ranker.threshold
    good = ((held["quality"] > 0) & (held["toxic"] == 0)).to_numpy()
    assert keep[good].mean() > 0.9 and (~keep[~good]).mean() > 0.75
    assert 0 < ranker.quantile < 1


def test_queries_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    forest, ranker = quality_rules.learn(docs, labels), preference.learn(docs, labels)
    for r in quality_rules.op7_quality_rules(spark, sf_dir).collect():
        x = text_stats([texts[r["doc_id"]]])[0][0]
        score = walk(forest, x) if x[0] else 0.0
        assert r["score"] == pytest.approx(score, abs=2e-6) and r["keep"] == (score >= quality_rules.CUT)
    for r in preference.op8_quality_classifier(spark, sf_dir).collect():
        found, wordy = preference.features([texts[r["doc_id"]]])
        score = sum(ranker.weights[f] for f in found[0]) if wordy[0] else None
        assert r["score"] == (None if score is None else pytest.approx(score, abs=2e-6)) and r["keep"] == (score is not None and score > ranker.threshold)


def test_learning_does_not_depend_on_the_order_of_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = (preference.learn(d, labels) for d in (docs, docs.repartition(7).orderBy("n_chars")))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold
    x, y = (quality_rules.learn(d, labels) for d in (docs, docs.repartition(7).orderBy("n_chars")))
    assert (x.value == y.value).all()


def test_the_sample_is_bounded_and_labels_agree(spark, hard, labels):
    found = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labelled_documents(hard, labels).collect()}
    assert found == {5: (1, 0), 4: (0, 0), 8: (0, 1), 9: (1, 0)}
    assert labelled_documents(hard.dropDuplicates(["doc_id"]), labels, 2).count() <= 2


@pytest.mark.parametrize("operator,keep", [(quality_rules, "keep_good"), (preference, "keep_preferred")])
def test_hard_rows(hard, nothing, labels, operator, keep):
    model = operator.learn(hard, labels)
    found = operator.score_documents(hard, model).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == hard.count() and not any(by[k]["keep"] for k in (1, 2, 3, 4))
    assert len({r["score"] for r in found if r["doc_id"] in (5, 6)}) == 1
    kept = getattr(operator, keep)(hard, model)
    assert kept.columns == hard.columns and kept.count() == sum(r["keep"] for r in found)
    assert operator.score_documents(nothing, model).count() == 0 == getattr(operator, keep)(nothing, model).count()
    for untaught in (operator.learn(hard, labels.limit(0)), operator.learn(nothing, labels), operator.learn(hard, labels.where("quality = 1"))):
        assert all(r["keep"] == (r["doc_id"] in (5, 6, 7, 8, 9, 10, 11) or r["doc_id"] is None and bool(r["score"] is not None and r["keep"])) for r in operator.score_documents(hard, untaught).collect())


def test_all_pairs_by_enumeration():
    rng = np.random.default_rng(3)
    s, good = rng.normal(0, 3, 300), rng.random(300) < 0.8
    chance = 1 / (1 + np.exp(s[good][:, None] - s[~good]))
    sums = preference.all_pairs(s, good)
    assert sums[good] == pytest.approx(chance.sum(axis=1), rel=1e-3, abs=1e-3) and sums[~good] == pytest.approx(chance.sum(axis=0), rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("broadcast", [True, False])
def test_the_ranker_learns_from_labels_beyond_20000(spark, monkeypatch, broadcast):
    """The only documents with a bad word are those that the former sample of 20,000 labels left out."""
    if not broadcast:
        monkeypatch.setattr(labelled, "BROADCAST_ROWS", 0)
    ids = spark.range(24_000).withColumnRenamed("id", "doc_id")
    ranks = [r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    late = set(ranks[20_000:])
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(300)]
    rows = [(d, " ".join(rng.choice(words, 12)) + (" vile" if d in late and d % 2 else " junk" if d % 10 == 1 else ""), int(not (d in late and d % 2 or d % 10 == 1))) for d in range(24_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id bigint, quality int, toxic int")
    ranker = preference.learn(docs, labels)
    scores = ranker.score([r[1] for r in rows])
    keep, vile, good = scores > ranker.threshold, np.array(["vile" in r[1] for r in rows]), np.array([r[2] > 0 for r in rows])
    assert vile.sum() > 1500 and (~keep[vile]).mean() > 0.99 and (~keep[~good]).mean() > 0.99 and keep[good].mean() > 0.99
    assert ranker.quantile == pytest.approx((scores <= ranker.threshold).mean(), abs=1e-9)
