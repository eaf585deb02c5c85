"""Queries of the subpackage and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, jaccard, langid, licenses, packing, quality, repeats, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": topk.op1_exact_topk,
        "op10_suffix_array_dedup": repeats.op10_suffix_array_dedup,
        "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_license_scan": licenses.op6_license_scan,
        "op7_warc_chunks": warc.op7_warc_chunks,
        "op8_language_id": langid.op8_language_id,
        "op9_byte_bpe": bpe.op9_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_topk": topk.SQL,
        "op10_suffix_array_dedup": repeats.SQL,
        "op2_ngram_jaccard_join": jaccard.SQL,
        "op5_exact_dedup": exact_dedup.SQL,
        "op7_warc_chunks": warc.SQL,
    }
