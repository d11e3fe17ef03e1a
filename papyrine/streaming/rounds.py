"""Rounds that can be replayed: a stream's batches go through report, store, seen and cursor, in that order.

A round's new rows are those of its batch, each key once, that the seen table lacks. Each sink takes a batch under its
number and takes none twice, so a round that broke off at any place is done again, by Spark's checkpoint, with the same end as if
it had not: what was taken before stays, what was not is added. A batch is written as it comes, so the source is asked once and all else
runs in the caller's session (a stream's own plans without adaptive execution, with all shuffle partitions however few the rows). What is
new is worked out once and written before the first sink, so that a replay behind the seen sink still finds it; of a batch's rows one a key and task
is shuffled. The cursor comes last, never goes back, and only moves after all else.

The seen table holds keys alone, in buckets by their hash; a batch reads the buckets of its own keys. It never forgets, so
repeats of any age are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyrine.sources.keyed import Files, KeyedTable

SINKS = ("report", "store", "seen", "cursor")


def first_each(batch: DataFrame, key: str, *order: str) -> DataFrame:
    """A row a key, the first in order; blank and null keys are dropped."""
    held = batch.where(F.col(key).isNotNull() & (F.btrim(F.col(key).cast("string")) != ""))
    return held.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(*order)).alias("_r")).select("_r.*")


class Rounds:
    """State of a chain of rounds under one path: store and seen tables, reports, the cursor."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, time: str, ties: tuple[str, ...] = (), bucket_rows: int = 100_000):
        self.spark, self.path, self.schema, self.key, self.time, self.ties = spark, path.rstrip("/"), schema, key, time, ties
        self.files = Files(spark, self.path)
        self.store = KeyedTable(spark, f"{self.path}/store", schema, key, bucket_rows)
        self.seen = KeyedTable(spark, f"{self.path}/seen", StructType([schema[key]]), key, bucket_rows)

    def cursor(self) -> tuple[int, datetime | None]:
        """The last batch that is through, and the newest time it is known to cover; -1 and None at first, or where the file is not readable."""
        try:
            held = json.loads(self.files.read("cursor.json") or "{}")
            return int(held["batch"]), datetime.fromisoformat(held["at"]) if held["at"] else None
        except (KeyError, TypeError, ValueError):
            return -1, None

    def reports(self) -> DataFrame:
        """What each batch that is through has reported: batch and new rows."""
        done = [n for n in self.files.folders("reports") if int(n.removeprefix("batch-")) <= self.cursor()[0]]
        schema = "batch long, rows long, oldest string, newest string"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/reports/{n}" for n in done]) if done else self.spark.createDataFrame([], schema)

    def run(self, batch: DataFrame, number: int, after: Callable[[str], None] = lambda sink: None) -> None:
        """One round. after is called when a sink is through; what it raises breaks the round off there."""
        if number <= self.cursor()[0]:
            return
        rows_path, fresh_path = f"{self.path}/rows/batch-{number}", f"{self.path}/fresh/batch-{number}"
        batch.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(rows_path)
        rows = self.spark.read.schema(self.schema).parquet(rows_path)
        live, newest = self._known(rows)
        if f"batch-{number}" not in self.files.folders("fresh") or self.files.read(f"fresh/batch-{number}/_SUCCESS") is None:
            one = first_each(rows, self.key, self.time, *self.ties)
            fresh = one.join(live, self.key, "left_anti").select(*self.schema.fieldNames())
            fresh.write.mode("overwrite").parquet(fresh_path)
        fresh = self.spark.read.schema(self.schema).parquet(fresh_path)
        sums = fresh.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("rows"), F.min(self.time).cast("string").alias("oldest"), F.max(self.time).cast("string").alias("newest"))
        sums.write.mode("overwrite").parquet(f"{self.path}/reports/batch-{number}")
        after("report")
        self.store.upsert(fresh, number, stored=True)
        after("store")
        self.seen.upsert(fresh.select(self.key), number, stored=True)
        after("seen")
        held = self.cursor()[1]
        newest = newest.replace(tzinfo=UTC) if newest is not None and newest.tzinfo is None else newest
        at = max([t for t in (held, newest) if t is not None], default=None)
        self.files.swap("cursor.json", json.dumps({"batch": number, "at": at.isoformat() if at else None}))
        after("cursor")
        self.files.drop(f"fresh/batch-{number}")
        self.files.drop(f"rows/batch-{number}")

    def _known(self, rows: DataFrame) -> tuple[DataFrame, datetime | None]:
        """The seen keys in the buckets of rows, and the rows' newest time; a row a bucket comes to the driver."""
        state = self.seen.state()
        found = self.seen.bucketed(rows, state["buckets"]).groupBy("_bucket").agg(F.max(self.time)).collect()
        live = {str(b): state["live"][str(b)] for b, _ in found if str(b) in state["live"]}
        return self.seen.read(live), max((t for _, t in found if t is not None), default=None)


def follow(stream: DataFrame, rounds: Rounds, after: Callable[[str], None] = lambda sink: None) -> None:
    """Runs a stream's batches, one at a time, until the source has no more, and goes on where an earlier call ended or broke off."""
    query = stream.writeStream.foreachBatch(lambda batch, number: rounds.run(batch, number, after)).option("checkpointLocation", f"{rounds.path}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
