"""op8: the quality rules over all documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import table
from papyrine.llm.quality_rules import COUNTS, STOP_WORDS, judge

NAME = "op8_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judge(docs).withColumn("base_failed", failed)
    return judged.select("doc_id", *COUNTS, "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
top AS (SELECT r, max(k) AS most FROM (SELECT r, word, count(*) AS k FROM (SELECT r, unnest(ws) AS word FROM w) GROUP BY r, word) GROUP BY r),
b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters, list_has_any(ws, [{STOPS}]) AS stops, coalesce(most, 0) AS most,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•·]'))) AS bullets,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots
      FROM w LEFT JOIN cov USING (r) LEFT JOIN top USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 100 * n_symbols > 30 * n_words OR 2 * n_dup_lines > n_lines
            OR 100 * letters < 60 * word_chars OR NOT stops OR 10 * most > 3 * n_words OR 10 * bullets > 9 * n_lines OR 10 * dots > 3 * n_lines) AS kept
FROM b
""".replace("{STOPS}", ", ".join(f"'{w}'" for w in STOP_WORDS))
