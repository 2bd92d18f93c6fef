"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import fingerprint, langid, line_dedup, mixing, pieces, pii, prefix_trie, quality, row_patterns, simhash, suffix_dedup, token_counts, topk


def queries() -> dict:
    return {
        "op1_fingerprint": fingerprint.op1_fingerprint,
        "op2_mixing": mixing.op2_mixing,
        "op3_language_id": langid.op3_language_id,
        "op4_topk": topk.op4_topk,
        "op5_pii": pii.op5_pii,
        "op6_sentencepiece": pieces.op6_sentencepiece,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_simhash": simhash.op8_simhash,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_row_patterns": row_patterns.op11_row_patterns,
        "op12_quality_rules": quality.op12_quality_rules,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op4_topk": topk.SQL, "op10_line_dedup": line_dedup.SQL, "op11_row_patterns": row_patterns.SQL, "op12_quality_rules": quality.SQL, "op13_prefix_trie": prefix_trie.SQL}
