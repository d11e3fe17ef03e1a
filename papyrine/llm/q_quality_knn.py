"""op5: quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import table
from papyrine.llm.labelled import fold
from papyrine.llm.quality_knn import fit, score

NAME = "op5_quality_knn"
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
