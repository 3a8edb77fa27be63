from collections import Counter

import pytest

import corpus_pipeline
from termforge.llm import decontam, packing, preference, quality_rules, simhash
from termforge.llm.stats import text_stats
from test_packing import checked
from test_simhash import groups_of, within


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return tuple(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))


def expected_ids(tables):
    """What is left before packing, by plain Python over all documents."""
    docs, labels, benchmark = tables
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    ranker, forest = preference.learn(docs, labels), quality_rules.learn(docs, labels)
    left = {d: t for d, t in left.items() if ranker.score([t])[0] > ranker.threshold}
    left = {d: t for d, t in left.items() if (x := text_stats([t])[0])[0, 0] and forest.score(x)[0] >= quality_rules.CUT}
    prints = [(d, *f) for d, f in zip(left, simhash.fingerprint_texts(list(left.values()))) if f]
    roots = groups_of(within(prints, simhash.TAU))
    left = {d: t for d, t in left.items() if roots.get(d, d) == d}
    strings = {r["string"] for r in decontam.item_strings(benchmark).where("NOT whole").collect()}
    plain = {r["doc_id"]: r["p"] for r in docs.select("doc_id", decontam.plain(docs["text"]).alias("p")).collect()}
    return {d for d in left if not any(s in plain[d] for s in strings)}


def test_run_against_brute_force(spark, sf_dir, tables):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    kept = expected_ids(tables)
    lengths = {r["doc_id"]: r["n"] for r in tables[0].select("doc_id", packing.token_length(tables[0]["text"]).alias("n")).collect()}
    assert checked(rows, Counter({d: lengths[d] for d in kept})) > 0


def test_stages_pass_on_the_columns_of_documents(spark, sf_dir, hard):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, hard, sf_dir)
        assert kept.columns == hard.columns and 0 <= kept.count() <= hard.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, hard, sf_dir)
    assert "doc_id" in packed.columns and packed.where("doc_id = 9").count() > 1


def test_stages_on_nothing(spark, sf_dir, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0
