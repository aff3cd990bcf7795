"""Queries of this subpackage and their DuckDB SQL."""

from . import chat_format, conversation_repair, decontaminate, exact_dedup, line_dedup, mixing, pii, secret_scan, simhash_dedup, substring_dedup, toxicity, url_filter, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_pii": pii.op7_pii,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_whitening": whitening.op12_whitening,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}
ORACLES = {
    "op1_url_filter": url_filter.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op4_mixing": mixing.SQL,
    "op6_chat_format": chat_format.SQL,
    "op7_pii": pii.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_secret_scan": secret_scan.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
