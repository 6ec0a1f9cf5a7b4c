"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, decontamination, language_id, line_dedup, merkle, neighbours, quality, secret_scan, sharding, simhash, substring_dedup, toxicity, vector_codes

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_language_id": language_id.op6_language_id,
    "op7_sharding": sharding.op7_sharding,
    "op8_simhash": simhash.op8_simhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_nearest_neighbours": neighbours.op12_nearest_neighbours,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op2_quality_rules": quality.ORACLE_SQL,
    "op5_decontamination": decontamination.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
