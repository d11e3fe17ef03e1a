"""An expensive scorer behind a cache: probe, batch the misses, score, validate, merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import canonical_sha256
from papyrine.operators.providers import score_batches, score_offline
from papyrine.operators.ranking import batches
from papyrine.sources.tables import checkpointed

SCORES, READINGS = "score:v2:", "deepread:v2:"
#: What a cached answer depends on besides its inputs; any change makes new keys.
SCORER = {"format": "2", "kind": "score", "model": "offline", "prompt": "1", "schema": "1"}
READER = {"format": "2", "kind": "deep_read", "model": "offline", "prompt": "1", "schema": "1", "temperature": "0.3"}


def cache_key(prefix: str, meta: dict[str, str], interest: Column, paper_id: Column, title: Column, summary: Column) -> Column:
    """prefix and the hash of all that an answer depends on, as JSON with its keys in order."""
    paper = F.struct(paper_id.alias("id"), summary.alias("summary"), title.alias("title"))
    return F.concat(F.lit(prefix), canonical_sha256(*[(k, F.lit(v)) for k, v in meta.items()], ("interest", interest), ("paper", paper)))


def sound(cache: DataFrame, prefix: str = SCORES) -> DataFrame:
    """cache: cache_key, score, reason. Entries of the right kind with a whole score from 0 to 10 and a reason that is not blank."""
    ok = F.col("cache_key").startswith(prefix) & F.col("score").between(0, 10) & (F.btrim("reason") != "")
    return cache.where(ok).select("cache_key", "score", F.btrim("reason").alias("reason"))


def score_cached(papers: DataFrame, cache: DataFrame, interest: str, meta: dict[str, str] = SCORER, scorer: Callable[[list[dict]], str] = score_offline) -> tuple[DataFrame, DataFrame]:
    """papers: paper_id, title, summary, rank (a funnel's rows, each rank once; a paper may be there twice). Gives paper_id, rank, score, reason, origin and bad; and the entries to add to the cache.

    Only misses are batched and scored. Rows of a batch that was amiss are given, but never cached; good batches of the same call are.
    """
    keyed = papers.withColumn("cache_key", cache_key(SCORES, meta, F.lit(interest), F.col("paper_id"), F.col("title"), F.col("summary")))
    held = keyed.join(sound(cache).dropDuplicates(["cache_key"]), "cache_key", "left")
    misses = batches(held.where("score IS NULL").drop("score", "reason")).withColumn("abstract", F.col("summary"))
    fresh = checkpointed(score_batches(misses.select("batch", "place", "paper_id", "title", "abstract"), scorer))  # so that the scorer is called once
    keys = misses.select("batch", "place", "rank", "cache_key")
    made = fresh.join(keys, ["batch", "place"])
    old = held.where("score IS NOT NULL").select("paper_id", "rank", F.col("score").cast("int").alias("score"), "reason", F.lit("cache").alias("origin"), F.lit(False).alias("bad"))
    all_ = old.unionByName(made.select("paper_id", "rank", "score", "reason", F.lit("scorer").alias("origin"), "bad"))
    return all_, made.where("NOT bad").select("cache_key", "score", "reason").dropDuplicates(["cache_key"])
