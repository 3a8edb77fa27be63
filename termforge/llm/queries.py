"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termforge.llm import arc, chat_events, crossparse, decontam, packing, preference, quality_rules, simhash, tokenfst, wrappers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_warc_arc_conversion": arc.op1_warc_arc_conversion,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_token_counts": tokenfst.op3_token_counts,
    "op4_lm_scoring": crossparse.op4_lm_scoring,
    "op5_html_extraction": wrappers.op5_html_extraction,
    "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_classifier": preference.op8_quality_classifier,
    "op9_chat_formatting": chat_events.op9_chat_formatting,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_warc_arc_conversion": arc.ORACLE_OP1,
    "op6_benchmark_decontamination": decontam.ORACLE_OP6,
    "op9_chat_formatting": chat_events.ORACLE_OP9,
}
