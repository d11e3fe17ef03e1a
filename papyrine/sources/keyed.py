"""A keyed table of files that is read and changed by bucket, one batch at a time.

Rows lie in buckets by a hash of their key, a folder a bucket and version. A batch reads only the buckets that its keys
fall into, writes those anew beside the old ones, and then swaps one small pointer file; whatever breaks off before leaves
the table as it was, and a batch that is done again after the swap changes nothing. The number of buckets doubles when
they hold more than `bucket_rows` on average, so what a batch reads depends on its own keys, not on the table's size.
Old versions stay until `vacuum`. One writer at a time; readers see the version they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyrine.sources.tables import checkpointed

BUCKET_ROWS, LEAST_BUCKETS = 100_000, 8


class Files:
    """Small files in whatever store Spark writes to."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.gateway, self.base = spark._jvm, spark.sparkContext._gateway, base.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def read(self, name: str) -> str | None:
        p = self.path(name)
        fs = p.getFileSystem(self.conf)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        """Writes beside and renames over, so that a reader finds the old text or the new one."""
        temp, p = self.path(f".{name}-{uuid.uuid4().hex}"), self.path(name)
        fs = p.getFileSystem(self.conf)
        fs.mkdirs(p.getParent())
        stream = fs.create(temp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(temp, p, options)

    def drop(self, name: str) -> None:
        p = self.path(name)
        p.getFileSystem(self.conf).delete(p, True)

    def folders(self, name: str) -> list[str]:
        p = self.path(name)
        fs = p.getFileSystem(self.conf)
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []


class KeyedTable:
    """schema: the rows' columns, `key` among them; null keys are refused by upsert."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, bucket_rows: int = BUCKET_ROWS, least_buckets: int = LEAST_BUCKETS):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.bucket_rows, self.least = bucket_rows, least_buckets
        self.files = Files(spark, path)

    def state(self) -> dict:
        """buckets, batch (the last one that is in) and live: bucket to folder and rows."""
        held = self.files.read("current.json")
        return json.loads(held) if held else {"buckets": self.least, "batch": -1, "live": {}}

    def bucketed(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int"))

    def read(self, live: dict | None = None) -> DataFrame:
        """The whole table, or the live buckets given."""
        live = self.state()["live"] if live is None else live
        if not live:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}/_bucket={b}" for b, (folder, _) in sorted(live.items())])

    def touched(self, keys: DataFrame, state: dict | None = None) -> dict:
        """The live buckets that keys fall into; a number a bucket comes to the driver."""
        state = state or self.state()
        found = self.bucketed(keys.select(self.key), state["buckets"]).select("_bucket").distinct().collect()
        return {str(r[0]): state["live"][str(r[0])] for r in found if str(r[0]) in state["live"]}

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys, from their buckets alone."""
        return self.read(self.touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi").select(*self.schema.fieldNames())

    def upsert(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame], DataFrame] | None = None, stored: bool = False) -> bool:
        """Puts a batch's rows in; False if that batch, or a later one, is in already.

        merge gets old and new rows together, with `_new`, and gives one row a key; without it the new one counts. rows have one row a key
        unless merge settles that. stored: rows are read from files and cost nothing to read again; others are written first.
        """
        state = self.state()
        if batch <= state["batch"]:
            return False
        rows = rows.select(*self.schema.fieldNames()).where(F.col(self.key).isNotNull())
        rows = rows if stored else checkpointed(rows)
        old = self.read(self.touched(rows, state))
        both = old.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
        one = merge(both) if merge else both.groupBy(self.key).agg(F.max_by(F.struct(*self.schema.fieldNames()), "_new").alias("r")).select("r.*")
        self._put(one.select(*self.schema.fieldNames()), state, batch)
        return True

    def _put(self, rows: DataFrame, state: dict, batch: int) -> None:
        folder = f"data-{uuid.uuid4().hex}"
        bucketed = self.bucketed(rows, state["buckets"])
        bucketed.repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        sizes = {}
        if self.files.folders(folder):  # without rows there are no buckets
            written = self.spark.read.parquet(f"{self.path}/{folder}")
            sizes = {str(r[0]): [folder, r[1]] for r in written.groupBy("_bucket").count().collect()}
        state = {**state, "batch": batch, "live": state["live"] | sizes}
        total = sum(n for _, n in state["live"].values())
        if total > self.bucket_rows * state["buckets"]:
            while total > self.bucket_rows * state["buckets"]:
                state["buckets"] *= 2
            every = self.read(state["live"])
            self._put(every, {**state, "live": {}}, batch)
            return
        self.files.swap("current.json", json.dumps(state))

    def vacuum(self) -> int:
        """Drops folders that no live bucket is in."""
        used = {folder for folder, _ in self.state()["live"].values()}
        gone = [f for f in self.files.folders("") if f.startswith("data-") and f not in used]
        for f in gone:
            self.files.drop(f)
        return len(gone)
