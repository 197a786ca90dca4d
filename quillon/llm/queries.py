"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import (
    decontaminate,
    embedding_dedup,
    filter_audit,
    language_id,
    licenses,
    lm_score,
    mixing,
    ngram_join,
    periodic_runs,
    pii,
    quality,
    token_counts,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_mixing": mixing.op2_mixing,
    "op3_licenses": licenses.op3_licenses,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality": quality.op10_quality,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_licenses": licenses.OP3_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
