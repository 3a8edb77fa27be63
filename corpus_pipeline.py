"""From raw documents to packed training sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works on all
the rows its predecessor kept. All but the last return the columns of ``documents``.

Defined results, besides those that each operator states: a null, empty or wordless text is rejected by the first stage; rows
without doc_id pass all stages by their text, and near-dedup leaves them; of rows that share a doc_id one is left after
near-dedup; equal texts are judged alike until then; texts of any length are read whole; extra columns, whatever their names,
are passed on by all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termforge.llm import common, decontam, packing, preference, quality_rules, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the preference model rejects go."""
    labelled = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return preference.keep_preferred(docs, preference.learn(*labelled))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees over their statistics reject go."""
    labelled = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return quality_rules.keep_good(docs, quality_rules.learn(*labelled))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark's test string go."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, placed in training sequences: a row for each piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The trained stages and best fit are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.cut(docs)
    return docs
