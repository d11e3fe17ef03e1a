"""Hash-stratified splits and evaluation snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.ranking import global_rank


def stratified(labels: DataFrame, ratio: float = 0.7, seed: int = 20260717) -> DataFrame:
    """labels: paper_id, label. Adds split: by label in hash order, the first round(n * ratio), at least 1 and at most n - 1, are dev.

    A label's only paper is dev if ratio is half or more. The order of the input has no effect.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must be between 0 and 1")
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), "label", "paper_id"), 256)
    # a range sort by label and hash, so that no task holds a label; a label's places begin behind those of the labels before
    ranked = global_rank(labels.withColumn("_h", h), F.col("label"), F.col("_h"), F.col("paper_id"), name="_place")
    held = ranked.groupBy("label").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    ranked = ranked.join(held, ranked["label"].eqNullSafe(held["label"])).drop(held["label"])
    n, place = F.col("_n"), F.col("_place") - F.col("_first") + 1
    dev = F.when(n == 1, F.lit(1 if ratio >= 0.5 else 0)).otherwise(F.least(F.greatest(F.bround(n * F.lit(ratio), 0), F.lit(1)), n - 1))
    return ranked.select(*[F.col(f"`{c}`") for c in labels.columns], F.when(place <= dev, "dev").otherwise("test").alias("split"))


def snapshot(papers: DataFrame, labels: DataFrame, scores: DataFrame, anchor: Column, ratio: float = 0.7, seed: int = 20260717) -> DataFrame:
    """id, title, summary, label, is_anchor, score, reason, split of every paper."""
    p = papers.withColumn("is_anchor", anchor)
    free = labels.join(p.where("is_anchor").select("paper_id"), "paper_id", "left_anti")
    held = p.join(labels, "paper_id", "left").join(stratified(free, ratio, seed).select("paper_id", "split"), "paper_id", "left").join(scores, "paper_id", "left")
    split = F.when(F.col("is_anchor"), "anchor").otherwise(F.coalesce("split", F.lit("unjudged")))
    return held.select(F.col("paper_id").alias("id"), "title", "summary", "label", "is_anchor", "score", F.when(F.col("score").isNotNull(), "frozen").alias("reason"), split.alias("split"))


def of_split(records: DataFrame, split: str) -> DataFrame:
    """Records a split's evaluation may see; unjudged ones always."""
    if split not in ("dev", "test", "all"):
        raise ValueError(f"unknown split {split}")
    out = {"dev": ("anchor", "test"), "test": ("anchor", "dev"), "all": ("anchor",)}[split]
    return records.where(~F.col("split").isin(*out))


def violations(records: DataFrame) -> DataFrame:
    """rule and number of records against it, each 0 in a sound snapshot."""
    ids = Window.partitionBy("id")
    r = records.withColumn("_times", F.count("*").over(ids))
    judged = F.col("label").isNotNull()
    rules = {
        "anchor flag": F.col("is_anchor") != (F.col("split") == "anchor"),
        "blank title": F.btrim("title") == "",
        "label value": judged & ~F.col("label").isin("rel", "irrel"),
        "repeated id": F.col("_times") > 1,
        "score range": F.col("score").isNotNull() & ~F.col("score").between(0, 10),
        "score with reason": F.col("score").isNull() != F.col("reason").isNull(),
        "split of judged": judged & (F.col("split") == "unjudged"),
        "split of unjudged": ~judged & ~F.col("split").isin("anchor", "unjudged"),
        "split value": ~F.col("split").isin("anchor", "dev", "test", "unjudged"),
    }
    one = [F.struct(F.lit(n).alias("rule"), F.count_if(x).alias("violations")) for n, x in rules.items()]
    return r.agg(F.array(*one).alias("v")).select(F.inline("v"))


FIELDS = ("id", "title", "summary", "label", "is_anchor", "score", "reason", "split")


def digest(records: DataFrame) -> DataFrame:
    """records and digest: a sum over the records' hashes, so it needs no order, counts repeats and changes with any field."""
    h = F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256)
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def rerun(records: DataFrame, ratio: float = 0.7, seed: int = 20260717) -> DataFrame:
    """Judged records that are no anchors whose split is not what stratified() gives again."""
    free = records.where(~F.col("is_anchor") & F.col("label").isNotNull())
    again = stratified(free.select(F.col("id").alias("paper_id"), "label"), ratio, seed).select(F.col("paper_id").alias("id"), F.col("split").alias("expected"))
    return free.join(again, "id").where(F.col("split") != F.col("expected")).select("id", "split", "expected")


def verify(records: DataFrame, held: DataFrame, ratio: float = 0.7, seed: int = 20260717) -> DataFrame:
    """violations, the split made again, and count and digest against those held (a row of digest())."""
    now = digest(records).select(F.col("records").alias("r"), F.col("digest").alias("d"))
    against = now.crossJoin(F.broadcast(held))  # a row each
    stored = against.select(F.lit("stored digest").alias("rule"), F.when((F.col("r") == F.col("records")) & (F.col("d") == F.col("digest")), 0).otherwise(1).cast("bigint").alias("violations"))
    again = rerun(records, ratio, seed).agg(F.lit("split made again").alias("rule"), F.count("*").alias("violations"))
    return violations(records).unionByName(again).unionByName(stored)


def read_snapshot(records: DataFrame, split: str = "all") -> DataFrame:
    """of_split of records that are sound; else the broken rules are raised."""
    broken = {r.rule: r.violations for r in violations(records).where("violations > 0").collect()}  # a row a rule
    if broken or records.isEmpty():
        raise ValueError(f"not a sound snapshot: {broken or 'no records'}")
    return of_split(records, split)
