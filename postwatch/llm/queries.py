"""Queries over the driver tables, one for each operator, and the SQL they are checked against."""

from __future__ import annotations

from postwatch.llm import (
    byte_bpe,
    decontaminate,
    hard_negatives,
    language,
    line_dedup,
    masked_lm,
    ngram_join,
    sentence_pieces,
    spot_signatures,
    token_counts,
    training_order,
    url_reputation,
    whitening,
)

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_spot_signatures": spot_signatures.query,
    "op4_line_dedup": line_dedup.query,
    "op5_language": language.query,
    "op6_ngram_join": ngram_join.query,
    "op7_token_counts": token_counts.query,
    "op8_masked_lm": masked_lm.query,
    "op9_training_order": training_order.query,
    "op10_url_reputation": url_reputation.query,
    "op11_sentence_pieces": sentence_pieces.query,
    "op12_whitening": whitening.query,
    "op13_hard_negatives": hard_negatives.query,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op10_url_reputation": url_reputation.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
