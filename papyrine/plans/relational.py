"""Scans, state, sets, judgments and routing as plain statements."""

from __future__ import annotations

from papyrine.plans.dual import ansi, spark_query

PAPERS = "papers AS (SELECT doc_id AS pos, #text(doc_id)# AS paper_id, split_part(text, '.', 1) AS title, text AS summary, lang, source AS category, n_chars FROM @documents)"
LABELS = "labels AS (SELECT #text(doc_id)# AS paper_id, CASE WHEN quality = 1 THEN 'rel' ELSE 'irrel' END AS label FROM @labels)"

_BOTH = {
    "window_counts": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM @events GROUP BY 1, 2",
    "fetch_window": "SELECT event_id, ts - INTERVAL '15' MINUTE AS since, least(ts, TIMESTAMP '2024-01-20 00:00:00') AS until FROM @events",
    "minute_stamp": "SELECT event_id, #stamp(ts)# AS stamp FROM @events",
    "iso_utc": "SELECT event_id, #iso(ts)# AS iso FROM @events",
    "as_utc": "SELECT event_id, CAST(replace(replace(#iso(ts)#, 'T', ' '), 'Z', '') AS TIMESTAMP_NTZ) AS ts FROM @events",
    "cursor_advance": "SELECT event_type, greatest(max(ts), TIMESTAMP '2024-01-15 00:00:00') AS cursor FROM @events GROUP BY event_type",
    "seen_union": f"WITH {PAPERS} SELECT DISTINCT paper_id FROM (SELECT paper_id FROM papers WHERE pos < 400 UNION ALL SELECT paper_id FROM papers WHERE pos >= 300) x WHERE paper_id <> ''",
    "store_append": f"""WITH {PAPERS},
incoming AS (SELECT paper_id, pos, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS n FROM (SELECT * FROM papers WHERE pos >= 300 UNION ALL SELECT * FROM papers WHERE pos % 7 = 0) x)
SELECT paper_id, pos, 'store' AS origin FROM papers WHERE pos < 400
UNION ALL SELECT paper_id, pos, 'incoming' FROM incoming i WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM papers p WHERE p.pos < 400 AND p.paper_id = i.paper_id)""",
    "paper_text": f"WITH {PAPERS} SELECT paper_id, concat(title, '. ', summary) AS text FROM papers",
    "tokenize": f"WITH {PAPERS} SELECT paper_id, CAST(cardinality_(#tokens(summary)#) AS BIGINT) AS n, #sha(array_to_string_(#tokens(summary)#))# AS digest FROM papers",
    "collapse_ws": "SELECT item_id, substring(#strip(text)#, 1, 200) AS text FROM @benchmark",
    "query_shape": "SELECT item_id, CAST(cardinality_(tokens_(text)) AS BIGINT) AS words, CAST(length(regexp_replace_(text)) AS BIGINT) AS clauses FROM @benchmark",
    "labels_left": f"WITH {PAPERS}, {LABELS} SELECT p.paper_id, l.label FROM papers p LEFT JOIN labels l ON p.paper_id = l.paper_id",
    "semi_pool": f"WITH {PAPERS}, {LABELS} SELECT paper_id, label FROM labels WHERE paper_id IN (SELECT paper_id FROM papers)",
    "unlabeled": f"WITH {PAPERS}, {LABELS} SELECT p.paper_id, p.pos FROM papers p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.paper_id = p.paper_id)",
    "eval_input": f"WITH {PAPERS}, {LABELS} SELECT p.paper_id, l.label FROM papers p LEFT JOIN labels l ON p.paper_id = l.paper_id WHERE p.pos % 50 <> 7 AND (l.label IS NULL OR l.label IN ('rel', 'irrel'))",
    "label_apply": f"""WITH {PAPERS}, {LABELS},
asked AS (SELECT row_no, label FROM (VALUES (1, 'rel'), (5, 'irrel'), (9, 'rel'), (12, 'irrel')) AS t(row_no, label)),
changed AS (SELECT p.paper_id, a.label FROM papers p JOIN asked a ON p.pos + 1 = a.row_no)
SELECT coalesce(l.paper_id, c.paper_id) AS paper_id, coalesce(c.label, l.label) AS label FROM labels l FULL OUTER JOIN changed c ON l.paper_id = c.paper_id""",
    "feedback_current": """WITH log AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'up' ELSE 'down' END AS label, ts,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM @events WHERE event_type IN ('click', 'error'))
SELECT user_id, label, ts FROM log WHERE n = 1""",
    "trace_tail": """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS back FROM @conversations)
SELECT conv_id, turn, role FROM t WHERE back <= 3""",
    "dup_check": "SELECT text, count(*) AS n FROM @documents GROUP BY text HAVING count(*) > 1",
    "fk_check": f"""WITH {PAPERS}, {LABELS}
SELECT 'label without paper' AS rule, count(*) AS violations FROM labels l WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.paper_id = l.paper_id)
UNION ALL SELECT 'anchor without paper', count(*) FROM (SELECT #text(vec_id)# AS id FROM @embeddings WHERE vec_id % 50 = 7) a WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.paper_id = a.id)
UNION ALL SELECT 'blank title', count(*) FROM papers WHERE trim(title) = ''""",
    "legacy_scores": f"""WITH {PAPERS}, cache AS (SELECT concat('v1:', #text(vec_id)#) AS cache_key, CAST(vec_id % 11 AS DOUBLE) AS score FROM @embeddings)
SELECT substring(cache_key, instr(cache_key, ':') + 1) AS paper_id, score FROM cache WHERE substring(cache_key, instr(cache_key, ':') + 1) IN (SELECT paper_id FROM papers)""",
    "cache_merge": """WITH old AS (SELECT vec_id AS k, vec_id % 11 AS score FROM @embeddings WHERE vec_id < 300),
new AS (SELECT vec_id AS k, vec_id % 7 AS score FROM @embeddings WHERE vec_id >= 200)
SELECT coalesce(new.k, old.k) AS vec_id, coalesce(new.score, old.score) AS score FROM old FULL OUTER JOIN new ON old.k = new.k""",
    "cache_write_set": """WITH b AS (SELECT vec_id, CAST(floor(vec_id / 8) AS BIGINT) AS batch_id, CASE WHEN vec_id % 37 = 0 THEN 99 ELSE vec_id % 11 END AS score FROM @embeddings)
SELECT vec_id, batch_id, score FROM b WHERE NOT EXISTS (SELECT 1 FROM b AS x WHERE x.batch_id = b.batch_id AND x.score NOT BETWEEN 0 AND 10)""",
    "snapshot_counts": f"""WITH {PAPERS}, {LABELS},
r AS (SELECT coalesce(l.label, 'unjudged') AS label, CASE WHEN p.pos % 50 = 7 THEN 'anchor' WHEN l.label IS NULL THEN 'unjudged' WHEN p.pos % 10 < 7 THEN 'dev' ELSE 'test' END AS split
  FROM papers p LEFT JOIN labels l ON p.paper_id = l.paper_id)
SELECT coalesce(label, '*') AS label, coalesce(split, '*') AS split, count(*) AS n FROM r GROUP BY GROUPING SETS ((), (label), (split), (split, label))""",
    "route_action": "SELECT action, CASE action WHEN 'widen' THEN 'fetch' WHEN 'refocus' THEN 'rank' ELSE 'report' END AS route FROM (VALUES ('widen'), ('refocus'), ('stop'), ('delete')) AS t(action)",
}

_FOR_SPARK = {"cardinality_(": "size(", "array_to_string_(": "array_join(", "tokens_(text)": "regexp_extract_all(text, '[A-Za-z0-9]+', 0)"}
_FOR_ANSI = {"cardinality_(": "len(", "tokens_(text)": "regexp_extract_all(text, '[A-Za-z0-9]+')", "TIMESTAMP_NTZ": "TIMESTAMP", "concat('score": "concat('score"}


def _spark(sql: str) -> str:
    sql = sql.replace("array_to_string_(#tokens(summary)#)", "array_join(#tokens(summary)#, ' ')")
    sql = sql.replace("length(regexp_replace_(text))", "size(filter(split(text, '[,;.]'), x -> btrim(x) <> ''))")
    for a, b in _FOR_SPARK.items():
        sql = sql.replace(a, b)
    return sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


def _ansi(sql: str) -> str:
    sql = sql.replace("array_to_string_(#tokens(summary)#)", "array_to_string(#tokens(summary)#, ' ')")
    sql = sql.replace("length(regexp_replace_(text))", "len(list_filter(regexp_split_to_array(text, '[,;.]'), lambda x: trim(x) <> ''))")
    for a, b in _FOR_ANSI.items():
        sql = sql.replace(a, b)
    return sql.replace("', ' ', 1)", "', ' ', 'g')").replace("', '', 1)", "', '', 'g')")


QUERIES = {name: spark_query(_spark(sql)) for name, sql in _BOTH.items()}
SQL = {name: ansi(_ansi(sql)) for name, sql in _BOTH.items()}
