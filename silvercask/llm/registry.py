"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe_codec, exact_dedup, ngram_join, packing, paragraphs, pii, quality, recurrent, repeats, token_counts

QUERIES: dict = {
    "op1_repeats": repeats.op1_repeats,
    "op2_pii": pii.op2_pii,
    "op3_paragraphs": paragraphs.op3_paragraphs,
    "op4_token_counts": token_counts.op4_token_counts,
    "op8_bpe_codec": bpe_codec.op8_bpe_codec,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op5_recurrent_scores": recurrent.op5_recurrent_scores,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLES: dict = {"op6_exact_dedup": exact_dedup.SQL}
