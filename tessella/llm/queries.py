"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessella.llm import exact_dedup, language_id, licenses, mixing, packing, periodic_runs, quality_rules, secrets, simhash_dedup, tiff, url_rules, vector_codes, warc

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_language_id": language_id.op2_language_id,
    "op3_warc": warc.op3_warc,
    "op4_mixing": mixing.op4_mixing,
    "op5_tiff": tiff.op5_tiff,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_secrets": secrets.op7_secrets,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_packing": packing.op9_packing,
    "op10_simhash_dedup": simhash_dedup.op10_simhash_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}
ORACLE_SQL = {
    "op1_licenses": licenses.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_url_rules": url_rules.OP8_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op13_quality_rules": quality_rules.OP13_SQL,
}
