"""op7: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import table
from papyrine.llm.labelled import fold
from papyrine.llm.toxicity import Model, fit, score

NAME = "op7_toxicity"
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


def model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, model(spark, docs, sf_dir))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
