"""Registry of the training-data queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockquery.llm import chat, ctw, decontaminate, fingerprint, jaccard_join, language_id, pieces, secrets, suffix_dedup, token_count

_MODULES = (token_count, language_id, secrets, fingerprint, decontaminate, jaccard_join, pieces, ctw, suffix_dedup, chat)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for module in _MODULES for name, function in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
