"""The training-data queries opN_<name> by name, and the SQL of those that SQL can state."""

from __future__ import annotations

from millrace.llm import filter_audit, language_id, license_scan, line_dedup, near_dedup, ogg_media, packing, quality_rules, secret_scan, source_mix, token_counts, token_files, vector_codes

QUERIES = {
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op1_source_mix": source_mix.op1_source_mix,
    "op2_language_id": language_id.op2_language_id,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_token_counts": token_counts.op4_token_counts,
    "op6_ogg_media": ogg_media.op6_ogg_media,
    "op7_packing": packing.op7_packing,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_token_files": token_files.op10_token_files,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op1_source_mix": source_mix.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op9_secret_scan": secret_scan.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
