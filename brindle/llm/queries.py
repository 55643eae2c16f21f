"""The queries of the training-data operators, by name."""

from __future__ import annotations

from . import bytepairs, centroids, collocations, html, langid, lm, mixing, neardup, packing, passages, phrases, pii, quantise


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": neardup.op1_minhash_near_dedup,
        "op2_packing": packing.op2_packing,
        "op3_additive_quantisation": quantise.op3_additive_quantisation,
        "op4_pii": pii.op4_pii,
        "op5_lm_score": lm.op5_lm_score,
        "op6_mixing": mixing.op6_mixing,
        "op7_html_extract": html.op7_html_extract,
        "op8_lz_fingerprint": phrases.op8_lz_fingerprint,
        "op9_substring_dedup": passages.op9_substring_dedup,
        "op10_language_id": langid.op10_language_id,
        "op11_collocations": collocations.op11_collocations,
        "op12_byte_bpe": bytepairs.op12_byte_bpe,
        "op13_centroids": centroids.op13_centroids,
    }


def oracle_sql() -> dict:
    """SQL where an operator's whole contract has one; tests/llm hold the others against brute-force versions, round trips or held-out accuracy."""
    return {"op11_collocations": collocations.sql(), "op13_centroids": centroids.sql()}
