"""A training corpus from raw documents: rules, toxicity, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Rows that a stage keeps are whole and
unchanged; mixing repeats rows. Labels are read from sf_dir, and only those of documents that the stage
is given can be learnt from.

An empty table gives an empty result, and a stage may reject all rows. A null text is empty: the rules reject it. Rows with a
null id go through the rules and toxicity like others, are never learnt from, and all stay at the near copies, where one row of each
component that has an id stays; mixing repeats them like others. Repeated rows of an id and text are copies, of which one stays.
A null source is a source of its own. Other columns, and their names, are kept up to packing, which returns its own. Very long texts go whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import jaccard, mixing, packing, quality_rules, toxicity
from papyrine.llm.common import count_words, scratch, table
from papyrine.llm.q_toxicity import THRESHOLD, model


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.where(toxicity.scored(F.col("text"), model(spark, docs, sf_dir)) < THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, count_words(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", rules),
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier nor the random rounding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
