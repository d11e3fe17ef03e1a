"""Snapshots as documents: records in the order of their ids, and a tree of hashes over ranges of them.

A document is a folder: `records`, a JSON line a record in files of rising ranges; `ranges`, a row for each range of RANGE_ROWS
records with its ends and its hash (of its records' hashes in their order); `document.json`, written last, with the schema, the policy, the counts by
label and split and the root hash, to which the ranges' hashes are folded FAN_IN at a time. So the order counts, any field that changes is seen, and
two documents that differ name the ranges that do. No task holds more than a range.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import splits as S
from papyrine.operators.ranking import global_rank
from papyrine.sources.keyed import Files

SCHEMA_ID, RANGE_ROWS, FAN_IN = "papyrine-snapshot/1", 1000, 1000
RECORD = "id string, title string, summary string, label string, is_anchor boolean, score double, reason string, split string"
POLICY = {"method": "stratified-hash", "ratio": 0.7, "seed": 20260717, "input": "seed:label:id"}


def _numbered(records: DataFrame) -> DataFrame:
    """Records with line (their JSON), h (its hash), and at, their place from 0 by id."""
    line = F.to_json(F.struct(*S.FIELDS), {"ignoreNullFields": "false"})
    held = records.select(*S.FIELDS).withColumn("line", line).withColumn("h", F.sha2("line", 256))
    return global_rank(held, F.col("id"), F.col("h"), name="at").withColumn("at", F.col("at") - 1)


def _folded(rows: DataFrame, size: int) -> DataFrame:
    """rows: at, h. The hash of each `size` of them, in order, and its place."""
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
    return rows.groupBy(F.floor(F.col("at") / size).alias("at")).agg(F.sha2(held, 256).alias("h"), F.count("*").alias("n"))


def ranges_of(numbered: DataFrame, size: int = RANGE_ROWS) -> DataFrame:
    """at, first, last, n and h of each range."""
    ends = numbered.groupBy(F.floor(F.col("at") / size).alias("at")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return _folded(numbered, size).join(ends, "at").select("at", "first", "last", "n", "h")


def root_of(ranges: DataFrame) -> str:
    level = ranges.select("at", "h")
    while (n := level.count()) > 1:
        level = _folded(level, FAN_IN).select("at", "h")
    return level.first().h if n else ""


def counts_of(records: DataFrame) -> dict[str, int]:
    """Records by label and split; a pair that could be, and is not, counts 0."""
    found = {(r.label or "unjudged", r.split): r["count"] for r in records.groupBy("label", "split").count().collect()}  # a row a pair
    pairs = [(label, split) for label in ("rel", "irrel", "unjudged") for split in ("anchor", "dev", "test", "unjudged")]
    return {f"{a}/{b}": found.get((a, b), 0) for a, b in sorted({*pairs, *found})}


def write(records: DataFrame, path: str, version: str, policy: dict = POLICY, size: int = RANGE_ROWS) -> dict:
    """Writes a document and gives its head. A folder that holds a document is refused."""
    spark, files = records.sparkSession, Files(records.sparkSession, path)
    if files.read("document.json") is not None:
        raise ValueError(f"there is a document at {path}")
    numbered = _numbered(records)
    numbered.repartitionByRange("at").sortWithinPartitions("at").select("line").write.mode("overwrite").text(f"{path}/records")
    ranges_of(numbered, size).repartitionByRange("at").sortWithinPartitions("at").write.mode("overwrite").parquet(f"{path}/ranges")
    ranges = spark.read.parquet(f"{path}/ranges")
    head = {"schema": SCHEMA_ID, "version": version, "policy": policy, "range_rows": size, "records": numbered.count(), "counts": counts_of(records), "root": root_of(ranges)}
    files.swap("document.json", json.dumps(head, sort_keys=True))
    return head


def head(spark: SparkSession, path: str) -> dict:
    held = Files(spark, path).read("document.json")
    if held is None:
        raise ValueError(f"no document at {path}")
    found = json.loads(held)
    if found.get("schema") != SCHEMA_ID:
        raise ValueError(f"unknown schema {found.get('schema')}")
    return found


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records; lines that are none have a null id."""
    return spark.read.text(f"{path}/records").select(F.from_json("value", RECORD).alias("r")).select("r.*")


def check(spark: SparkSession, path: str, other: str) -> DataFrame:
    """at, first and last of the ranges in which two documents differ; none if they hold the same records. Texts are not read."""
    a, b = (spark.read.parquet(f"{p}/ranges") for p in (path, other))
    met = a.join(b.select("at", F.col("first").alias("first2"), F.col("last").alias("last2"), F.col("h").alias("h2")), "at", "full").where(~F.col("h").eqNullSafe(F.col("h2")))
    return met.select("at", F.coalesce("first", "first2").alias("first"), F.coalesce("last", "last2").alias("last"))


def verify(spark: SparkSession, path: str) -> list[str]:
    """All that is amiss with a document: rules its records break, their order, counts, policy, split and hashes."""
    held, found = head(spark, path), []
    records = read(spark, path)
    if held["records"] < 1:
        found.append("no records")
    found += [f"{r.rule}: {r.violations}" for r in S.violations(records).where("violations > 0").collect()]  # a row a rule
    if (blank := records.where("id IS NULL OR btrim(id) = '' OR summary IS NULL OR title IS NULL OR is_anchor IS NULL OR split IS NULL").count()) > 0:
        found.append(f"missing field: {blank}")
    lines = spark.read.text(f"{path}/records").select("value", "_metadata.file_path", "_metadata.file_block_start").withColumn("at", F.monotonically_increasing_id())
    order = lines.select(F.get_json_object("value", "$.id").alias("id"), "file_path", "at")
    ends = order.groupBy("file_path").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    ends = sorted((r.file_path, r.low, r.high) for r in ends.collect())  # a row a file
    turned = any(a[2] is None or b[1] is None or a[2] >= b[1] for a, b in zip(ends, ends[1:], strict=False))
    within = order.withColumn("before", F.lag("id").over(S.Window.partitionBy("file_path", F.shiftright("at", 33)).orderBy("at"))).where("before >= id").count()
    if turned or within:
        found.append("order of ids")
    if held["counts"] != counts_of(records) or held["records"] != records.count():
        found.append("counts")
    policy = held["policy"]
    sound = isinstance(policy, dict) and set(policy) == set(POLICY) and policy["method"] == POLICY["method"] and isinstance(policy["ratio"], float) and 0 < policy["ratio"] < 1 and type(policy["seed"]) is int
    if not sound:
        found.append("policy")
    elif not S.rerun(records, policy["ratio"], policy["seed"]).isEmpty():
        found.append("split made again")
    now = ranges_of(_numbered(records), held["range_rows"])
    stored = spark.read.parquet(f"{path}/ranges")
    apart = now.select("at", "h").exceptAll(stored.select("at", "h")).unionByName(stored.select("at", "h").exceptAll(now.select("at", "h"))).select("at").distinct()
    if bad := [r.at for r in apart.orderBy("at").limit(20).collect()]:
        found.append(f"ranges {bad}")
    if root_of(stored) != held["root"]:
        found.append("root")
    return found
