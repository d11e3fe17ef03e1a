"""op2: all documents mixed to the sources' targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import count_words, table
from papyrine.llm.mixing import copies

NAME = "op2_mixing"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    mixed = copies(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
