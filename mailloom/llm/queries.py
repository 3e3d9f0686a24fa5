"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, jaccard, packing, periodic, quality, recurrent, secretscan, simhash, tokencount, topk, toxicity, whitening

QUERIES = {
    "op1_secret_scan": secretscan.op1_secret_scan,
    "op2_topk": topk.op2_topk,
    "op3_packing": packing.op3_packing,
    "op4_lm_score": recurrent.op4_lm_score,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_chat_format": chat.op7_chat_format,
    "op8_token_counts": tokencount.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
    "op11_simhash": simhash.op11_simhash,
    "op12_whitening": whitening.op12_whitening,
    "op13_periodic_runs": periodic.op13_periodic_runs,
    "secret_counts": secretscan.secret_counts,
    "quality_counts": quality.quality_counts,
    "whitening_deviation": whitening.whitening_deviation,
}
SQL = {"op5_jaccard_join": jaccard.SQL, "op2_topk": topk.SQL, "op7_chat_format": chat.SQL, "secret_counts": secretscan.COUNTS_SQL, "quality_counts": quality.COUNTS_SQL, "whitening_deviation": whitening.DEVIATION_SQL}
