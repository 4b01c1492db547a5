"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from lodestone.llm.audit import OP13_SQL, op13_filter_audit
from lodestone.llm.language import op3_language_id
from lodestone.llm.leaks import OP11_SQL, op11_benchmark_leaks
from lodestone.llm.licenses import op1_license_scan, op1_sql
from lodestone.llm.lines import OP5_SQL, op5_line_dedup
from lodestone.llm.media import op6_media_columns
from lodestone.llm.mixing import op7_source_mixing
from lodestone.llm.near import op2_minhash_near_dedup
from lodestone.llm.pieces import op10_sentencepiece
from lodestone.llm.topk import OP8_SQL, op8_exact_topk
from lodestone.llm.toxicity import op4_toxicity
from lodestone.llm.trie import OP12_SQL, op12_conversation_trie
from lodestone.llm.urls import op9_url_filters


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_language_id": op3_language_id,
        "op4_toxicity": op4_toxicity,
        "op5_line_dedup": op5_line_dedup,
        "op6_media_columns": op6_media_columns,
        "op7_source_mixing": op7_source_mixing,
        "op8_exact_topk": op8_exact_topk,
        "op9_url_filters": op9_url_filters,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_benchmark_leaks": op11_benchmark_leaks,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": op1_sql(), "op5_line_dedup": OP5_SQL, "op8_exact_topk": OP8_SQL, "op11_benchmark_leaks": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
