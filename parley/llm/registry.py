"""The queries of this subpackage."""

from __future__ import annotations

from parley.llm import centroids, chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, neighbours, recompression, simhash, suffix_dedup, vector_codes


def queries() -> dict:
    return {
        "op1_simhash_dedup": simhash.query,
        "op2_line_dedup": line_dedup.query,
        "op3_mix_sources": mixing.query,
        "op4_recompression_dedup": recompression.query,
        "op5_license_scan": license_scan.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_language_id": language_id.query,
        "op8_decontaminate": decontaminate.query,
        "op9_chat_format": chat_format.query,
        "op10_nearest_neighbours": neighbours.query,
        "op11_centroid_clustering": centroids.query,
        "op12_vector_codes": vector_codes.query,
        "op13_exact_dedup": exact_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_recompression_dedup": recompression.SQL,
        "op6_suffix_dedup": suffix_dedup.SQL,
        "op9_chat_format": chat_format.SQL,
        "op11_centroid_clustering": centroids.SQL,
        "op12_vector_codes": vector_codes.SQL,
        "op13_exact_dedup": exact_dedup.SQL,
    }
