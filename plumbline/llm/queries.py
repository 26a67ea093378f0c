"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    chunk_dedup, decontaminate, hard_negatives, language, licences, lm_score, mixing, near_dup, pii, ranked_search, topk,
    toxicity, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(_table(spark, sf_dir, name) for name in tables))

    run.__name__ = operator.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licences": _over(licences.op1_licences, "documents"),
        "op2_personal_data": _over(pii.op2_personal_data, "documents"),
        "op3_decontaminate": _over(decontaminate.op3_decontaminate, "documents", "benchmark"),
        "op4_mix": _over(mixing.op4_mix, "documents"),
        "op5_language_id": _over(language.op5_language_id, "documents"),
        "op6_near_duplicates": _over(near_dup.op6_near_duplicates, "documents"),
        "op7_top_k": _over(topk.op7_top_k, "embeddings"),
        "op8_toxicity": _over(toxicity.op8_toxicity, "documents", "labels"),
        "op9_lm_score": _over(lm_score.op9_lm_score, "documents"),
        "op10_chunk_dedup": _over(chunk_dedup.op10_chunk_dedup, "documents"),
        "op11_ranked_search": _over(ranked_search.op11_ranked_search, "documents", "benchmark"),
        "op12_url_filter": _over(url_filter.op12_url_filter, "pages"),
        "op13_hard_negatives": _over(hard_negatives.op13_hard_negatives, "embeddings"),
    }


def oracle_sql() -> dict[str, str]:
    """Queries whose whole result SQL can express; the others are tested against brute force."""
    return {"op4_mix": mixing.OP4_SQL, "op7_top_k": topk.OP7_SQL, "op11_ranked_search": ranked_search.OP11_SQL,
            "op13_hard_negatives": hard_negatives.OP13_SQL}
