"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with NAME, query and, where SQL can express it, SQL.
MODULES = (
    "jaccard",
    "quality_rules",
    "mixing",
    "chat_format",
    "packing",
    "token_files",
    "quality_knn",
    "toxicity",
    "warc",
    "neighbours",
    "sessions",
    "suffix_tree",
    "whitening",
)


def _modules():
    return [importlib.import_module(f"papyrine.llm.q_{m}") for m in MODULES]


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _modules()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if getattr(m, "SQL", None)}
