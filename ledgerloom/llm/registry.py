"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import flac, hnsw, language_id, mixing, near_dedup, sentencepiece_fst, sharding, suffix_dedup, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_flac": flac.op1_flac,
        "op2_bin_packing": sharding.op2_bin_packing,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_embedding_dedup": hnsw.op5_embedding_dedup,
        "embedding_dedup_with_copies": hnsw.embedding_dedup_with_copies,
        "op6_mixing": mixing.op6_mixing,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language_id": language_id.op9_language_id,
        "op10_sentencepiece": sentencepiece_fst.op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_flac": flac.SQL, "op6_mixing": mixing.mixing_sql()} | hnsw.SQL
