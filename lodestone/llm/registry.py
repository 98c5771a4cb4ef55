"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, chat, html_text, language_model, packing, passages, quality, simhash, spelling, token_counts, topk, vector_codes, viterbi


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sum_of_squares_packing": packing.op1_sum_of_squares_packing,
        "op2_simhash_near_duplicates": simhash.op2_simhash_near_duplicates,
        "op3_log_bilinear_scores": language_model.op3_log_bilinear_scores,
        "op4_crf_main_text": html_text.op4_crf_main_text,
        "op5_uniform_threshold_search": topk.op5_uniform_threshold_search,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_repeated_phrase_automata": passages.op7_repeated_phrase_automata,
        "op8_perspective_rotation": chat.op8_perspective_rotation,
        "op9_compression_bands": quality.op9_compression_bands,
        "op10_streaming_viterbi": viterbi.op10_streaming_viterbi,
        "op11_best_fit_packing": best_fit.op11_best_fit_packing,
        "op12_delta_lloyd_codes": vector_codes.op12_delta_lloyd_codes,
        "op13_symmetric_delete_variants": spelling.op13_symmetric_delete_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_uniform_threshold_search": topk.OP5_SQL,
        "op8_perspective_rotation": chat.OP8_SQL,
        "op12_delta_lloyd_codes": vector_codes.OP12_SQL,
    }
