"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, bpe_tree, chat, decontaminate, jaccard, langid, lines, merkle, quality, sharding, spelling, suffixes, topk

QUERIES = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op4_kd_shards": sharding.op4_kd_shards,
    "op5_maxscore": topk.op5_maxscore,
    "op7_chat_format": chat.op7_chat_format,
    "op3_line_dedup": lines.op3_line_dedup,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op8_quality": quality.op8_quality,
    "op10_language_id": langid.op10_language_id,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_segment_bpe": bpe_tree.op13_segment_bpe,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op5_maxscore": topk.OP5_SQL,
    "op6_ngram_jaccard": jaccard.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
