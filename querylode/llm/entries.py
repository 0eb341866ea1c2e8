"""The queries of this package and their SQL, for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querylode.llm import decontamination, jaccard_join, packing, ppm_score, quality, secrets, token_counts, token_files, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
        "op3_secret_scans": secrets.op3_secret_scans,
        "op4_token_files": token_files.op4_token_files,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_lm_scoring": ppm_score.op6_lm_scoring,
        "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": jaccard_join.ORACLE, "op10_url_filter": url_filter.oracle(url_filter.default_model())}
