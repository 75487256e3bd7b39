"""Registered queries of the numbered operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from loregraph.llm import bpe, conversation_repair, filter_audit, fingerprints, jaccard_join, language_id, mixing, quality, super_minhash, token_files, token_rollups, topk_search, warc


def queries() -> dict:
    return {
        "op1_token_files": token_files.op1_token_files,
        "op2_ngram_jaccard": jaccard_join.op2_ngram_jaccard,
        "op3_topk_search": topk_search.op3_topk_search,
        "op4_mixing": mixing.op4_mixing,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_warc": warc.op6_warc,
        "op7_bpe_encode_decode": bpe.op7_bpe_encode_decode,
        "op8_language_id": language_id.op8_language_id,
        "op9_quality": quality.op9_quality,
        "op10_token_rollups": token_rollups.op10_token_rollups,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_super_minhash": super_minhash.op13_super_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.OP4_SQL,
        "op6_warc": warc.OP6_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
    }
