"""The operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streamcontract.llm import exact_topk, hmm, media, mixing, near_dedup, pieces, quality, sharding, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_exact_topk": exact_topk.op2_exact_topk,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_sharding": sharding.op4_sharding,
        "op5_hmm": hmm.op5_hmm,
        "op6_quality": quality.op6_quality,
        "op7_mixing": mixing.op7_mixing,
        "op8_media": media.op8_media,
        "op9_pieces": pieces.op9_pieces,
        "op10_near_dedup": near_dedup.op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": exact_topk.SQL, "op10_near_dedup": near_dedup.SQL}
