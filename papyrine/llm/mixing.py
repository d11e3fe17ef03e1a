"""Mixing sources to target sizes by pivotal dependent rounding, in DataFrame functions only.

A source of size S gets a target T, so each of its documents wants T / S copies (3 at most). The whole
part is given outright. The fractional parts are rounded by pivotal steps: two documents trade
probability at equal mass (size times probability) until one is 0 or 1, at random with probabilities
that keep each one's expectation; the other goes on. So a source's taken words keep to its target but
for its last document's fraction. The steps form a tree: leaves of about FANIN documents by hash of
the key, each folded to one residual document; the residuals of FANIN leaves meet in the next level,
until one is left a source, which goes to the nearer whole. No node holds more than a few FANIN rows,
however large a source is, and random numbers are hashes of keys, so reruns agree.

Nulls: a null source is a source of its own, ordered last; a null text has no words. Documents without
words take 0. Repeated rows are documents of their own (told apart by their occurrence). An empty table
gives no rows. Only key, size and source are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.common import cut, let

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
FANIN = 256
#: Sources up to this many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
EPS = 1e-12

_ITEM = "struct<h:bigint,id:bigint,occ:int,size:bigint,whole:int,p:double>"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes: source, size. Gives source, n_docs, source_size and target.

    The fixed point of sharing by weight, stopping at most * size and resharing the excess: with sources
    by rising cap / weight, the first whose share of what remains is within its cap fixes the level.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    by = by.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    by = by.withColumn("ratio", F.col("cap") / F.col("w"))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, whole = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    by = by.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return by.select("source", "n_docs", "source_size", F.least("cap", F.coalesce(first, F.lit(0.0)) * F.col("w")).alias("target"))


def _uniform(*parts) -> Column:
    """From 0 to 1, by hash."""
    return (F.xxhash64(F.lit("mix"), *parts).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)


def _with(item: Column, p: Column) -> Column:
    snapped = let(p, lambda q: F.when(q < EPS, 0.0).when(q > 1 - EPS, 1.0).otherwise(q))
    return F.struct(item["h"].alias("h"), item["id"].alias("id"), item["occ"].alias("occ"), item["size"].alias("size"), item["whole"].alias("whole"), snapped.alias("p"))


def _step(a: Column, b: Column) -> Column:
    """Two items after one pivotal step, as an array; mass is kept and one at least is integral."""
    gain = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])  # mass that a can take from b
    loss = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))

    def traded(x: Column) -> Column:
        moved = F.when(_uniform(a["h"], b["h"], a["occ"], b["occ"]) * (x["up"] + x["down"]) < x["down"], x["up"]).otherwise(-x["down"])
        return let(moved, lambda m: F.array(_with(a, a["p"] + m / a["size"]), _with(b, b["p"] - m / b["size"])))

    return let(F.struct(gain.alias("up"), loss.alias("down")), traded)


def _fold(items: Column) -> Column:
    """A node: items in a fixed order folded to those decided and one residual, which may be null."""
    zero = F.struct(F.lit(None).cast(_ITEM).alias("cur"), F.array().cast(f"array<{_ITEM}>").alias("done"))

    def merge(acc: Column, x: Column) -> Column:
        pair = F.when(acc["cur"].isNull(), F.array(x)).otherwise(_step(acc["cur"], x))

        def settle(now: Column) -> Column:
            def fixed(i: Column) -> Column:
                return (i["p"] <= 0) | (i["p"] >= 1)
            left = F.get(F.filter(now, lambda i: ~fixed(i)), 0)
            return F.struct(left.cast(_ITEM).alias("cur"), F.concat(acc["done"], F.filter(now, fixed)).cast(f"array<{_ITEM}>").alias("done"))

        return let(pair, settle)

    return F.aggregate(items, zero, merge)


def copies(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, fanin: int = FANIN) -> DataFrame:
    """docs: doc_id, source, size. Gives for each row doc_id, occ, source, size, source_size, target and copies."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "source", F.col("size").cast("long").alias("size"))
    of = cut(targets(docs, weights, most))
    n_sources, largest = of.agg(F.count("*"), F.max("n_docs")).first()
    occ = F.row_number().over(Window.partitionBy("id").orderBy("source", "size"))
    docs = docs.withColumn("occ", occ)
    joined = docs.join(F.broadcast(of) if n_sources <= BROADCAST_SOURCES else of, docs.source.eqNullSafe(of.source)).drop(of.source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole, part = F.floor(F.col("rate") + EPS), F.col("rate") - F.floor(F.col("rate") + EPS)
    rated = joined.withColumn("rate", rate).withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0).cast("int"))
    rated = rated.withColumn("p", F.when((F.col("size") > 0) & (part > EPS), part).otherwise(0.0))
    keep = ["source", "n_docs", "source_size", "target"]
    out = ["id", "occ", "source", "size", "source_size", "target", "copies"]
    settled = rated.where("p = 0").withColumn("copies", F.col("whole")).select(*out)
    item = F.struct(F.xxhash64("id", "occ", "source").alias("h"), "id", "occ", "size", "whole", "p").cast(_ITEM).alias("item")
    open_ = rated.where("p > 0").select(*keep, item)
    leaf = F.pmod(F.col("item.h"), F.ceil(F.col("n_docs") / F.lit(fanin)))
    open_ = open_.withColumn("node", leaf)
    nodes = max(1, math.ceil((largest or 1) / fanin))
    found = [settled]
    while True:
        grouped = open_.groupBy(*keep, "node").agg(F.sort_array(F.collect_list("item")).alias("items"))
        level = cut(grouped.select(*keep, "node", _fold(F.col("items")).alias("f")))
        done = level.select(*keep, F.explode("f.done").alias("item"))
        left = level.where("f.cur IS NOT NULL").select(*keep, F.col("f.cur").alias("item"), F.col("node"))
        last = nodes == 1
        if last:  # one residual a source
            rounded = F.when(F.col("item.p") >= 0.5, 1.0).otherwise(0.0)
            done = done.unionByName(left.select(*keep, _with(F.col("item"), rounded).alias("item")))
        found.append(done.select("item.id", "item.occ", "source", "item.size", "source_size", "target", (F.col("item.whole") + F.col("item.p").cast("int")).alias("copies")).select(*out))
        if last:
            break
        open_ = left.withColumn("node", F.floor(F.col("node") / fanin))
        nodes = math.ceil(nodes / fanin)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.withColumnRenamed("id", "doc_id")


def mix(docs: DataFrame, sizes: Column, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The documents with as many rows as the mix takes of each: copies repeat a row, 0 drops it."""
    taken = copies(docs.select("doc_id", "source", sizes.alias("size")), weights, most)
    taken = taken.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("occ", "copies"))).alias("c"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), sizes.alias("size"))
    joined = rows.join(taken, rows.id.eqNullSafe(taken.doc_id))
    place = F.row_number().over(Window.partitionBy("id").orderBy("row.source", "size"))
    numbered = joined.withColumn("n", F.get(F.col("c"), place - 1)["copies"]).where("n > 0")
    return numbered.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
