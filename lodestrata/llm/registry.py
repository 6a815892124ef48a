"""The queries of this package and, where SQL can express them, the SQL that they are held against."""

from lodestrata.llm import chat, decontam, langid, layout, licenses, lm, mixing, packing, quality, secrets, simjoin, variants, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_language_id": langid.op3_language_id,
    "op4_mixing": mixing.op4_mixing,
    "op5_jaccard_join": simjoin.op5_jaccard_join,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_clustered_layout": layout.op13_clustered_layout,
}
ORACLES = {
    "op1_warc": warc.ORACLE_SQL,
    "op2_chat_formatting": chat.ORACLE_SQL,
    "op5_jaccard_join": simjoin.ORACLE_SQL,
    "op6_secret_scan": secrets.ORACLE_SQL,
    "op7_license_scan": licenses.ORACLE_SQL,
    "op8_quality_rules": quality.ORACLE_SQL,
    "op9_decontamination": decontam.ORACLE_SQL,
    "op12_spelling_variants": variants.ORACLE_SQL,
    "op13_clustered_layout": layout.ORACLE_SQL,
}
