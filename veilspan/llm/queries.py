"""The queries of this subpackage for the entry module, and their SQL."""

from __future__ import annotations

from . import chat_format, decontamination, license_scan, line_dedup, lz_fingerprint, near_dedup, packing, substring_dedup, toxicity, url_filters

QUERIES = {
    "op1_benchmark_decontamination": decontamination.op1_benchmark_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_document_fingerprints": lz_fingerprint.op3_document_fingerprints,
    "op4_chat_format": chat_format.op4_chat_format,
    "op6_url_filters": url_filters.op6_url_filters,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
}

ORACLES = {
    "op1_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op6_url_filters": url_filters.ORACLE_SQL,
}
