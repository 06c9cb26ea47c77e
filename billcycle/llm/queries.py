"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from billcycle.llm import (
    chat,
    decontaminate,
    language,
    lattice_lm,
    mixing,
    neighbours,
    ngram_join,
    periodic_runs,
    quality,
    token_counts,
    token_ids,
    vector_dedup,
    whitening,
)
from billcycle.llm.common import ship_code


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_code(spark)
        return query(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_mixing": mixing.op1_mixing,
        "op2_token_ids": token_ids.op2_token_ids,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_language": language.op5_language,
        "op6_vectors": vector_dedup.op6_vectors,
        "op7_chat": chat.op7_chat,
        "op8_quality": quality.op8_quality,
        "op9_lattice_lm": lattice_lm.op9_lattice_lm,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "op11_neighbours": neighbours.op11_neighbours,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_whitening": whitening.op13_whitening,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.mixing_sql(),
        "op3_decontamination": decontaminate.decontamination_sql(),
        "op6_vectors": vector_dedup.vectors_sql(),
        "op7_chat": chat.chat_sql(),
        "op10_ngram_join": ngram_join.join_sql(),
        "op12_periodic_runs": periodic_runs.runs_sql(),
    }
