"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from layoutlens.llm import bpe, chat_format, decontaminate, divergence, fingerprints, language_id, lm_scoring, near_dedup, phrases, pii, quality, secrets, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1,
    "op2_lm_scoring": lm_scoring.op2,
    "op3_toxicity": toxicity.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_language_id": language_id.op5,
    "op6_chat_format": chat_format.op6,
    "op7_quality": quality.op7,
    "op8_near_dedup": near_dedup.op8,
    "op9_secrets": secrets.op9,
    "op10_bpe": bpe.op10,
    "op11_phrases": phrases.op11,
    "op12_pii": pii.op12,
    "op13_divergence": divergence.op13,
}
ORACLES = {
    "op1_fingerprints": fingerprints.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
