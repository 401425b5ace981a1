"""The queries of this subpackage, and the SQL that checks those of them that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import alignment, langid, licenses, lines, mixing, neardup, ngrams, packing, pii, quality, repair, secrets, toolcalls


def bound() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        langid.op1_language_id,
        ngrams.op2_ngram_join,
        lines.op3_line_dedup,
        pii.op4_pii,
        quality.op5_quality_rules,
        packing.op6_best_fit,
        neardup.op7_embedding_dedup,
        secrets.op8_secret_scan,
        mixing.op9_source_mix,
        toolcalls.op10_tool_calls,
        alignment.op11_token_alignment,
        licenses.op12_license_scan,
        repair.op13_conversation_repair,
    )
    return {f.__name__: f for f in found}


def all_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": ngrams.sql(),
        "op5_quality_rules": quality.sql(),
        "op7_embedding_dedup": neardup.sql(),
        "op9_source_mix": mixing.sql(),
        "op10_tool_calls": toolcalls.sql(),
        "op12_license_scan": licenses.sql(),
        "op13_conversation_repair": repair.sql(),
    }
