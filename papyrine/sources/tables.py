"""Views of the stored tables as the engine's own relations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, paper_id, title, summary, lang, category, n_chars. pos carries the input order."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("paper_id"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("summary"),
        "lang",
        F.col("source").alias("category"),
        "n_chars",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id and label, rel or irrel; a paper without a row is unjudged."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), F.when(F.col("quality") == 1, "rel").otherwise("irrel").alias("label"))


def is_anchor(pos):
    return pos % 50 == 7


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir; one of our own where it is unset, which only a local master can share."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="papyrine-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the folder that executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
