"""The subpackage's queries and their SQL."""

from __future__ import annotations

from millrace.llm import decontaminate, fixity, langid, licenses, line_dedup, ngram_join, packing, quality, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_ngram_jaccard": ngram_join.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_benchmark_decontamination": decontaminate.query,
        "op5_language_id": langid.query,
        "op6_warc_merkle": fixity.query,
        "op7_toxicity": toxicity.query,
        "op8_quality_rules": quality.query,
        "op9_license_scan": licenses.query,
        "op10_line_dedup": line_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc_merkle": fixity.SQL,
        "op10_line_dedup": line_dedup.SQL,
    }
