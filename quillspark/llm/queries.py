"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, conversation_repair, decontamination, divergence, jaccard_join, language, packing, privacy, quality, secrets, sharding, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_packing": packing.query,
        "op3_secrets": secrets.query,
        "op4_privacy": privacy.query,
        "op5_decontamination": decontamination.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_language": language.query,
        "op8_token_files": token_files.query,
        "op9_sharding": sharding.query,
        "op10_toxicity": toxicity.query,
        "op11_divergence": divergence.query,
        "op12_conversation_repair": conversation_repair.query,
        "op13_byte_bpe": byte_bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": jaccard_join.SQL, "op9_sharding": sharding.SQL, "op11_divergence": divergence.SQL, "op12_conversation_repair": conversation_repair.SQL}
