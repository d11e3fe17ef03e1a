"""Judged ranking metrics, classification metrics, estimates and baselines."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.ranking import global_rank

#: Draws for each row that a trial needs.
SPARE = 8


def f1(p: Column, r: Column) -> Column:
    """NULL where either is; 0 where both are 0."""
    return F.when(p.isNull() | r.isNull(), F.lit(None)).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def judged(rankings: DataFrame, labels: DataFrame, k: int = 10, by: str = "method") -> DataFrame:
    """rankings: by, paper_id, rank. Precision over the judged of the top k, recall over all rel labels, coverage of the top."""
    n_rel = labels.where("label = 'rel'").agg(F.count("*").alias("n_rel"))
    top = rankings.where(F.col("rank") <= k).join(labels, "paper_id", "left")
    rows = top.groupBy(by).agg(F.count_if(F.col("label") == "rel").alias("rel"), F.count("label").alias("judged"), F.count("*").alias("size")).crossJoin(F.broadcast(n_rel))
    precision, recall = F.try_divide("rel", "judged"), F.try_divide("rel", "n_rel")
    return rows.select(by, precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"), F.coalesce(F.try_divide("judged", "size"), F.lit(0.0)).alias("coverage"), "rel", "judged", "n_rel")


def legacy(rankings: DataFrame, labels: DataFrame, k: int = 10, by: str = "method") -> DataFrame:
    m = judged(rankings, labels, k, by)
    size = rankings.where(F.col("rank") <= k).groupBy(by).agg(F.count("*").alias("size"))
    return m.join(size, by).select(by, F.coalesce(F.try_divide("rel", "size"), F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"), "judged")


def classification(scored: DataFrame, threshold: float = 7) -> DataFrame:
    """scored: score, label. One row over the judged rows."""
    s = scored.where(F.col("label").isin("rel", "irrel"))
    yes, rel = F.col("score") >= threshold, F.col("label") == "rel"
    c = s.agg(*[F.count_if(x).alias(n) for n, x in (("tp", yes & rel), ("fp", yes & ~rel), ("fn", ~yes & rel), ("tn", ~yes & ~rel))])
    c = c.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    div = F.try_divide
    c = c.withColumns({
        "accuracy": div(F.col("tp") + F.col("tn"), F.col("n")),
        "precision": div(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": div(F.col("tp"), F.col("tp") + F.col("fn")),
        "specificity": div(F.col("tn"), F.col("tn") + F.col("fp")),
        "majority": div(F.greatest(F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")), F.col("n")),
        "expected": div((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp")), F.col("n") * F.col("n")),
    })
    kappa = F.when(F.col("expected") == 1, F.lit(None)).otherwise(div(F.col("accuracy") - F.col("expected"), 1 - F.col("expected")))
    return c.select("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"), "specificity", ((F.col("recall") + F.col("specificity")) / 2).alias("balanced_accuracy"), kappa.alias("kappa"), "majority")


def estimate(values: DataFrame, *names: str) -> DataFrame:
    """metric, mean, std (population) and valid, ignoring nulls."""
    one = [F.struct(F.lit(n).alias("metric"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.count(n).alias("valid")) for n in names]
    return values.agg(F.array(*one).alias("e")).select(F.inline("e"))


def random_trials(pool: DataFrame, trials: int, k: int, seed: int) -> DataFrame:
    """trial, paper_id, rank: k papers a trial, of the whole pool, in order of a hash of seed, trial and id."""
    if trials < 1 or k < 1:
        raise ValueError("trials and k must be positive")

    def least(batches):
        """A partition's k least hashes of each trial."""
        kept = [[] for _ in range(trials)]
        for batch in batches:
            ids = [i.encode() for i in batch.column(0).to_pylist() if i is not None]
            for at in range(0, len(ids), 1000):
                part = ids[at : at + 1000]
                for t, best in enumerate(kept):
                    first = f"{seed}:{t}:".encode()
                    bound = best[-1][0] if len(best) == k else b"\xff" * 33
                    if found := [(h, i) for i in part if (h := sha256(first + i).digest()) < bound]:
                        kept[t] = sorted(best + found)[:k]
        rows = [(t, h, i.decode()) for t, best in enumerate(kept) for h, i in best]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else ([], [], []), (pa.int64(), pa.binary(), pa.string()), strict=True)], ["trial", "h", "paper_id"])

    ids = pool.select("paper_id").repartition(pool.sparkSession.sparkContext.defaultParallelism)  # an id is little to read and hashed once a trial
    n = F.row_number().over(Window.partitionBy("trial").orderBy("h"))
    drawn = ids.mapInArrow(least, "trial long, h binary, paper_id string")
    return drawn.withColumn("rank", n).where(F.col("rank") <= k).select("trial", "paper_id", F.col("rank").cast("bigint").alias("rank"))


def drawn_trials(pool: DataFrame, trials: int, k: int, seed: int) -> DataFrame:
    """trial, paper_id, rank: k papers a trial without repeats, at positions drawn by hash; work is trials * k and one sort of the ids.

    Draw j of a trial is the position sha256(seed:trial:j) modulo the pool's size, over ids in their order. A trial's first k different ones
    count, out of SPARE * k draws; in a pool too small for that to be sure, of less than SPARE * k, all positions are ordered by hash instead.
    """
    if trials < 1 or k < 1:
        raise ValueError("trials and k must be positive")
    numbered = global_rank(pool.select("paper_id").where("paper_id IS NOT NULL"), F.col("paper_id"))
    n = numbered.count()
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), "trial", "j"), 256)
    draws = pool.sparkSession.range(trials).withColumnRenamed("id", "trial")
    small = n < SPARE * k
    draws = draws.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit((max(n, 1) if small else SPARE * k) - 1)))).withColumn("h", hashed)
    if small:
        first = draws.withColumn("rank", F.col("j") + 1).withColumn("by", F.col("h"))
    else:
        at = F.pmod(F.conv(F.substring("h", 1, 15), 16, 10).cast("long"), F.lit(n)) + 1
        first = draws.groupBy("trial", at.alias("rank")).agg(F.min("j").alias("by"))
    place = F.row_number().over(Window.partitionBy("trial").orderBy("by"))  # SPARE * k rows a trial
    chosen = first.withColumn("place", place.cast("bigint")).where(F.col("place") <= k).select("trial", "rank", "place")
    return chosen.join(numbered, "rank").select("trial", "paper_id", F.col("place").alias("rank"))
