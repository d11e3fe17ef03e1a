"""Token ids in Parquet list columns, in ascending document order.

Documents are dealt out by ranges of doc_id (ties by length and hash of the text, so a repeated id is
split too), sorted as text, encoded and written by Spark's committer, so a lost task is simply run
again. Ids are dictionary-coded (16 bits or fewer an id), other integers delta-coded; row groups and
pages are small, and their indexes let a reader fetch the tokens or only the metadata of a few documents.
Readers get each document's start (ids of all before it) from the files' rows: sums within a file, then
over files.

Nulls: a null text is empty, a null doc_id comes first. Empty texts have the end id only. Repeated rows
are documents of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.llm.word_ids import word_ids

ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 64 << 10


def encode_documents(docs: DataFrame, end: int = 2, path: str | None = None) -> DataFrame:
    """doc_id and ids, in ascending order over partitions."""
    keys = [F.col("doc_id").asc_nulls_first(), "n", "h"]
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.length(text).alias("n"), F.xxhash64(text).alias("h"))
    ordered = docs.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def run(batches):
        words = word_ids(path)
        for batch in batches:
            at = 0
            for n, values, offsets in words.parts(batch.column(1), end):
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), ids], ["doc_id", "ids"])
                at += n

    return ordered.mapInArrow(run, "doc_id long, ids array<int>")


def write_tokens(docs: DataFrame, to: str, end: int = 2, path: str | None = None) -> None:
    encoded = encode_documents(docs, end, path).select("doc_id", F.size("ids").alias("n_tokens"), "ids")
    options = {
        "parquet.writer.version": "v2",
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.bloom.filter.enabled": "false",
    }
    encoded.write.options(**options).parquet(to)


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the file and row of each."""
    return spark.read.parquet(at).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def with_starts(rows: DataFrame) -> DataFrame:
    """rows: file, row, n_tokens. Adds start; files follow by the number that Spark's committer gives them."""
    inside = Window.partitionBy("file").orderBy("row")
    rows = rows.withColumn("inside", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("sum"))  # a row a file
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    files = files.select("file", (F.sum("sum").over(Window.orderBy(number, "file")) - F.col("sum")).alias("before"))
    return rows.join(files, "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def digests(tokens: DataFrame) -> DataFrame:
    """read_tokens' rows with the number and CRC-32 of the ids read in place of the ids."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), batch.column("file"), batch.column("row")], ["doc_id", "n_tokens", "ids_crc32", "file", "row"])

    return tokens.select("doc_id", "ids", "file", "row").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file string, row long")


def metadata(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, n_tokens and start of every document; no page of ids is read."""
    rows = spark.read.parquet(at).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return with_starts(rows).select("doc_id", "n_tokens", "start")


def token_range(spark: SparkSession, at: str, first: int, last: int) -> DataFrame:
    """doc_id and ids of documents first to last; their doc_ids are pushed down to row groups and pages."""
    return spark.read.parquet(at).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")
