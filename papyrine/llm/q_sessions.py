"""op11: clicks split into sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm.common import table
from papyrine.llm.sessions import sessions

NAME = "op11_sessions"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "clicks").select("click_id", "ts", "arrived_at", "client_id", "kind", "value"))


#: The sessions' starts are found by recursion: from a start to the first click of its island beyond the limit.
SQL = """WITH RECURSIVE one AS (
  SELECT click_id, min(struct_pack(us := epoch_us(ts), client := client_id, arrived := epoch_us(arrived_at), fin := coalesce(kind = 'purchase' AND value >= 60, false), cents := CAST(floor(100 * coalesce(value, 0) + 0.5) AS BIGINT))) AS r
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL GROUP BY click_id),
c AS (SELECT click_id, r.client AS client_id, r.us AS us, r.fin AS fin, r.cents AS cents, coalesce(r.arrived - r.us > 3600000000, false) AS late FROM one),
t AS (SELECT *, lag(us) OVER w AS p, lag(fin) OVER w AS pf FROM c WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
i AS (SELECT *, count(*) FILTER (p IS NULL OR pf OR us - p >= 1800000000) OVER (PARTITION BY client_id ORDER BY us, click_id) AS island, row_number() OVER (PARTITION BY client_id ORDER BY us, click_id) AS n FROM t),
u AS (SELECT client_id, island, us, min(click_id) AS click_id FROM i GROUP BY ALL),
nx AS MATERIALIZED (SELECT i.client_id, i.click_id, u.click_id AS next_id FROM i ASOF JOIN u ON i.client_id = u.client_id AND i.island = u.island AND u.us > i.us + 7200000000),
s AS (SELECT client_id, click_id FROM i WHERE p IS NULL OR pf OR us - p >= 1800000000
  UNION ALL SELECT s.client_id, nx.next_id FROM s JOIN nx ON s.client_id = nx.client_id AND s.click_id = nx.click_id),
m AS (SELECT i.*, s.click_id IS NOT NULL AS starts FROM i LEFT JOIN s ON i.client_id = s.client_id AND i.click_id = s.click_id),
g AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY client_id ORDER BY us, click_id) AS no FROM m),
a AS (SELECT client_id, no, arg_min(click_id, n) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents, arg_max(fin, n) AS fin,
  sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY us, click_id)) AS path_sha256 FROM g GROUP BY client_id, no),
b AS (SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY no) AS next_us FROM a),
l AS (SELECT b.client_id, b.no, count(*) AS n_late FROM b JOIN c ON c.late AND c.client_id = b.client_id AND c.us >= b.start_us AND (b.next_us IS NULL OR c.us < b.next_us) GROUP BY ALL)
SELECT b.client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents,
  CASE WHEN fin THEN 'end' WHEN next_us IS NULL THEN 'none' WHEN next_us - end_us >= 1800000000 THEN 'gap' ELSE 'length' END AS closed_by, path_sha256
FROM b LEFT JOIN l ON b.client_id = l.client_id AND b.no = l.no"""
