"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, htmltext, language, packing, quality, sharding, simhash, suffix, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op9_warc_history": warc.op9_warc_history,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op10_suffix_dedup": suffix.op10_suffix_dedup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_language_id": language.op3_language_id,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_html_extraction": htmltext.op5_html_extraction,
        "op6_packing": packing.op6_packing,
        "op7_ring_sharding": sharding.op7_ring_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.OP1_SQL,
        "op4_decontamination": decontaminate.OP4_SQL,
    }
