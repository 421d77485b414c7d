"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, chat_format, decontamination, fill_in_middle, language_id, line_dedup, minhash, quality_classifier, quality_rules, sharding, simhash, url_filter, vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        url_filter.op1_url_filter, chat_format.op2_chat_format, language_id.op3_language_id, quality_classifier.op4_quality_classifier, quality_rules.op5_quality_rules,
        simhash.op6_simhash, bpe.op7_bpe, line_dedup.op8_line_dedup, sharding.op9_sharding, decontamination.op10_decontamination,
        fill_in_middle.op11_fill_in_middle, vector_codes.op12_vector_codes, minhash.op13_minhash,
    )
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE_SQL, "op2_chat_format": chat_format.ORACLE_SQL, "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL, "op10_decontamination": decontamination.ORACLE_SQL,
    "op11_fill_in_middle": fill_in_middle.ORACLE_SQL, "op12_vector_codes": vector_codes.ORACLE_SQL, "op13_minhash": minhash.ORACLE_SQL,
}
