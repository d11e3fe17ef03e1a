"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import cut, drop_shuffles

#: Edges that a task takes, and tasks that a step has at least: many small steps would else leave many small files behind.
EDGES_A_TASK, LEAST_TASKS = 50_000, 12


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Gives id and component, the least id reachable, for every id in an edge.

    Each round hooks every node to its least neighbour, jumps pointers and contracts the edges, so the
    rounds are about the logarithm of a component's width; a round's shuffles go when it is over. Its steps have as many
    tasks as the edges need. Nothing is collected. Loops, repeated edges and either
    direction are allowed, an edge with a null end is left out, no edges give no rows; other columns are not read.
    """
    edges = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = edges.count()
    tasks = max(LEAST_TASKS, -(-n // EDGES_A_TASK))
    edges = edges.coalesce(tasks)
    found = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")).coalesce(tasks))
    while n:
        parent = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")).coalesce(tasks)  # a node with a smaller neighbour hooks
        for _ in range(2):
            up = parent.select(F.col("id").alias("up_id"), F.col("to").alias("up"))
            parent = cut(parent.join(up, parent["to"] == up["up_id"], "left").select("id", F.coalesce("up", "to").alias("to")).coalesce(tasks))
        left, right = (parent.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        moved = edges.join(left, "a", "left").coalesce(tasks).join(right, "b", "left").coalesce(tasks)
        moved = moved.select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y")).where("x != y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().coalesce(tasks))
        step = parent.select(F.col("id").alias("component"), "to")
        found = cut(found.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component")).coalesce(tasks))
        n = edges.count()
        drop_shuffles(edges.sparkSession)
    return found
