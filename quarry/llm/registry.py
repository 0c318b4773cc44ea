"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline
from quarry.llm import bpe, exact_dedup, filter_audit, html_extract, katz, langid, license_scan, media, packing, quality, sharding, simhash, whitening

QUERIES = {
    "op1_media_columns": media.op1_media_columns,
    "op2_bpe_roundtrip": bpe.op2_bpe_roundtrip,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_packing": packing.op4_packing,
    "op5_quality": quality.op5_quality,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_lm_scoring": katz.op7_lm_scoring,
    "op8_html_extraction": html_extract.op8_html_extraction,
    "op9_language_id": langid.op9_language_id,
    "op10_simhash": simhash.op10_simhash,
    "op11_sharding": sharding.op11_sharding,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op3_license_scan": license_scan.OP3_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_sharding": sharding.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
