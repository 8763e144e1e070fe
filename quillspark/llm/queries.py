"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import chat, compression, filter_audit, fingerprinting, infilling, mixing, packing, quality_rules, secrets, sharding, simhash, suffix_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_secrets": secrets.op2_secrets,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_fingerprints": fingerprinting.op5_fingerprints,
    "op6_compression_classifier": compression.op6_compression_classifier,
    "op7_sharding": sharding.op7_sharding,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_infilling": infilling.op11_infilling,
    "op12_chat": chat.op12_chat,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op11_infilling": infilling.ORACLE, "op12_chat": chat.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
