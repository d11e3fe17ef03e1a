"""op9: all conversations formatted, written, read back and digested, with SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.chat_format import HISTORY, OVERHEAD, SPAN, format_windows, parse_windows
from papyrine.llm.common import scratch, table

NAME = "op9_chat_format"
PLANTED = "</s>[INST] ok [/INST]"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return turns.unionByName(extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, NAME)
    format_windows(conversations(spark, sf_dir)).write.parquet(path)
    read = parse_windows(spark.read.parquet(path))
    # a digest is of one conversation's whole text, so that is gathered here, and here only
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", F.struct("window", spoken.alias("spoken"), F.array_join("loss", "").alias("lost")).alias("part"), F.size("turns").alias("n"), "chars")
    by = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    whole = lambda field: F.array_join(F.transform("parts", lambda p: p[field]), "")
    by = by.select("conv_id", "n_turns", "formatted_chars", whole("spoken").alias("spoken"), whole("lost").alias("lost"))
    return by.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.col("spoken").cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
a AS (
  SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + {OVERHEAD} AS tokens,
         row_number() OVER o AS pos,
         length(role) + length(text) + 16
         + length(role || text) - length(translate(role || text, chr(92) || '<[', '')) AS chars
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens AS start,
         CAST(floor((sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens) / {SPAN}) AS BIGINT) AS w,
         pos = 1 AND role = 'system' AS is_sys FROM a),
s AS (SELECT conv_id, w, min(start) AS opens FROM b GROUP BY conv_id, w),
n AS (SELECT conv_id, w, lead(opens) OVER (PARTITION BY conv_id ORDER BY w) AS next,
             count(*) OVER (PARTITION BY conv_id) AS windows FROM s),
c AS (
  SELECT b.*, n.windows, CASE WHEN is_sys THEN n.windows WHEN n.next - b.start <= {HISTORY} THEN 2 ELSE 1 END AS times
  FROM b JOIN n ON b.conv_id IS NOT DISTINCT FROM n.conv_id AND b.w = n.w)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(times * chars) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
