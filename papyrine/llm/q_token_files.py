"""op10: all documents as token ids in Parquet, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm.common import scratch, table
from papyrine.llm.token_files import digests, read_tokens, with_starts, write_tokens

NAME = "op10_token_files"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, NAME)
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return with_starts(digests(read_tokens(spark, path))).select("doc_id", "start", "n_tokens", "ids_crc32")
