"""The queries of the operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from . import bpe, decontaminate, html, lang, licences, merkle, minhash, pii, reputation, spelling, suffixes, topk, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_top_k": topk.op3_top_k,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_suffix_dedup": suffixes.op6_suffix_dedup,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_language_id": lang.op8_language_id,
    "op9_licences": licences.op9_licences,
    "op10_main_text": html.op10_main_text,
    "op11_spelling": spelling.op11_spelling,
    "op12_merkle": merkle.op12_merkle,
    "op13_url_filter": reputation.op13_url_filter,
}
ORACLES = {"op3_top_k": topk.ORACLE, "op6_suffix_dedup": suffixes.ORACLE, "op11_spelling": spelling.ORACLE, "op12_merkle": merkle.ORACLE, "op13_url_filter": reputation.ORACLE}
