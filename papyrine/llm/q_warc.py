"""op6: all pages as WARC records, written, normalised and read back; with SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm.common import scratch, table
from papyrine.llm.warc import archive, read_archives

NAME = "op6_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, NAME)
    index = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(index, f"{path}/records")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
