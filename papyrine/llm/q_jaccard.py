"""op1: near-copy classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm.common import table
from papyrine.llm.jaccard import classes

NAME = "op1_ngram_jaccard_join"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
