"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import audit, chat, decontaminate, licenses, lm, mixing, neardup, spelling, tokens, topk, toxicity, urls, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_chat_format": chat.op2_chat_format,
    "op3_url_filter": urls.op3_url_filter,
    "op4_lm_score": lm.op4_lm_score,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_warc": warc.op7_warc,
    "op8_token_count": tokens.op8_token_count,
    "op9_mix": mixing.op9_mix,
    "op10_top_k": topk.op10_top_k,
    "op11_license_scan": licenses.op11_license_scan,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_chat_format": chat.SQL,
    "op3_url_filter": urls.SQL,
    "op6_near_duplicates": neardup.SQL,
    "op7_warc": warc.SQL,
    "op9_mix": mixing.SQL,
    "op10_top_k": topk.SQL,
    "op11_license_scan": licenses.SQL,
    "op12_filter_audit": audit.SQL,
    "op13_spelling_variants": spelling.SQL,
}
