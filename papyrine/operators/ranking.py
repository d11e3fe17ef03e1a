"""Ranks over whole pools, and what is done with the head of a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.sources.tables import checkpointed

FUNNEL, TOP_K, BATCH, RELEVANT = 30, 5, 8, 7
FALLBACK_REASON = "scoring failed; fused order kept"


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds positions from 1 in the order given, without a single-task window.

    Rows are sorted by range; a row's position is its place in its range and the sizes of the ranges
    before, of which there are as many as partitions. The order must be total for a repeatable result.
    """
    ordered = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")
    sizes = F.broadcast(sizes.select("_p", before.alias("_before")))  # a row a partition
    ranked = ordered.withColumn("_p", part).join(sizes, "_p")
    return ranked.withColumn(name, (F.col("_before") + place + 1).cast("bigint")).drop("_at", "_p", "_before")


def funnel(ranking: DataFrame, rank: str = "rank", n: int = FUNNEL) -> DataFrame:
    """The head that an expensive scorer may see; cut, so that no later plan runs the scorer on more."""
    return checkpointed(ranking.orderBy(rank).limit(n))


def with_frozen(candidates: DataFrame, scores: DataFrame, key: str = "paper_id") -> DataFrame:
    """Adds score, reason and failed (one flag for all); a missing or invalid score is 0."""
    valid = F.col("raw").isNotNull() & ~F.isnan("raw") & F.col("raw").between(0, 10)
    held = candidates.join(scores.select(key, F.col("score").cast("double").alias("raw")), key, "left")
    held = held.withColumn("score", F.when(valid, F.col("raw")).otherwise(0.0)).withColumn("bad", ~F.coalesce(valid, F.lit(False)))
    held = held.withColumn("reason", F.when(F.col("bad"), "missing frozen score").otherwise("frozen"))
    return held.withColumn("failed", F.max("bad").over(Window.partitionBy())).drop("raw", "bad")


def final_order(scored: DataFrame, bonus: Column | float = 0.0, rank: str = "rank", top_k: int = TOP_K) -> DataFrame:
    """The top by score and bonus, ties by fused rank; by fused rank alone where scoring failed."""
    key = F.when(F.col("failed"), 0.0).otherwise(F.col("score") + bonus)
    reason = F.when(F.col("failed"), FALLBACK_REASON).otherwise(F.col("reason"))
    scored = scored.withColumn("key", key).withColumn("reason", reason)
    return scored.orderBy(F.desc("key"), rank).limit(top_k).withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("key"), rank)).cast("bigint"))


def batches(misses: DataFrame, rank: str = "rank", size: int = BATCH) -> DataFrame:
    """Adds batch and place (from 1 in the batch) by rank, over a funnel's rows."""
    n = F.row_number().over(Window.orderBy(rank)) - 1
    return misses.withColumn("batch", F.floor(n / size).cast("bigint")).withColumn("place", (n % size + 1).cast("bigint"))
