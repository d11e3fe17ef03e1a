"""Incremental ingest as a stream: each micro-batch adds what the seen table lacks.

The seen table is unbounded and lives in files, not in the state store, so late repeats of any age are
dropped. A batch that is replayed after a crash adds nothing twice, since it is compared with what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_rows(batch: DataFrame, seen: DataFrame | None, key: str, order: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    fresh = batch.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("_n", first).where("_n = 1").drop("_n")
    return fresh if seen is None else fresh.join(seen.select(key).distinct(), key, "left_anti")


def ingest(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str, key: str = "event_id", order: str = "ts", pattern: str = "*.parquet") -> None:
    """Reads all that is there, to the end, and appends it to store."""

    def add(batch: DataFrame, epoch: int) -> None:
        fs = spark._jvm.org.apache.hadoop.fs.Path(store)
        there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
        rows = new_rows(batch, spark.read.schema(batch.schema).parquet(store) if there else None, key, order)
        rows.write.mode("append").parquet(store)

    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
