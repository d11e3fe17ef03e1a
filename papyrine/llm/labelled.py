"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """doc_id, text and y of at most per_class documents of either label, least hash first, among labels where learn holds.

    Rows with a null id or label are left out; an id with several labels counts once, with the largest; of several
    rows of one id the text of the least hash counts, so the sample is bounded by rows too.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = reduce(DataFrame.unionByName, parts)
    # the chosen ids are bounded by twice per_class, so they may be broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return one.select("doc_id", F.col("least.text").alias("text"), "y")
