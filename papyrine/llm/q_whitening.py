"""op13: embeddings whitened along their first components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm.common import table
from papyrine.llm.whitening import whiten

NAME = "op13_whitening"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
