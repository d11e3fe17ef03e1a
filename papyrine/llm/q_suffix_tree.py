"""op12: all documents scored by a suffix tree of nine tenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import table
from papyrine.llm.labelled import fold
from papyrine.llm.suffix_tree import scored

NAME = "op12_suffix_tree"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fold(F.col("doc_id"), 10) == 0)
