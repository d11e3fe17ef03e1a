"""The incremental round, the cached scorer, facts of a loop's state and the benchmark of decisions, each with its SQL."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from papyrine.operators import cached as C
from papyrine.operators import decision as D
from papyrine.operators import incremental as I
from papyrine.operators import scenarios as S
from papyrine.plans import retrieval as R
from papyrine.plans.decisions import values
from papyrine.sources.tables import is_anchor, papers, table

# id, query, categories, scores, attempts, reflections, fetch failed, scoring failed
STATES = [
    (1, "Language agents with retrieval and planning", "cs.AI,cs.LG", "2,1", 1, 0, 0, 0),
    (2, "Artificial intelligence, vision, robotics, language, security, databases; retrieval", "cs.AI,cs.LG,cs.CL,cs.CV,cs.RO", "3,3,1", 1, 0, 0, 0),
    (3, "Reliable agents", "cs.AI,cs.LG", "6,3,2", 1, 0, 0, 0),
    (4, "Reliable agents", "cs.AI,cs.LG,cs.CL,cs.IR", "", 1, 0, 0, 0),
    (5, "Language agent research methods", "cs.AI,cs.LG,cs.CL", "8,7,9,7", 1, 0, 0, 0),
    (6, "Planning", "cs.AI,cs.LG,cs.CL,cs.IR", "2,2", 3, 1, 0, 0),
    (7, "Planning", "cs.AI,cs.LG", "2,7", 1, 3, 0, 0),
    (8, "Planning", "cs.AI,cs.LG", "2", 1, 0, 1, 0),
    (9, "Planning", "cs.AI,cs.LG", "2", 1, 0, 0, 1),
    (10, "Search-based planning for language-model agents", "cs.AI,cs.LG", "1", 1, 0, 0, 0),
    (11, "Planning agents that act well over long noisy inputs,,,, ", "cs.AI,cs.LG", "1", 1, 0, 0, 0),
    (12, "Storage, multi-agent planning; games, proofs. Vision, speech and text", "cs.AI,cs.LG,cs.MA", "1", 1, 0, 0, 0),
]
NAMES = "state_id, query, categories, scores, attempts, reflections, fetch_failed, score_failed"


def states(spark):
    kinds = ", ".join(f"{n} {'string' if i in (1, 2, 3) else 'long'}" for i, n in enumerate(NAMES.split(", ")))
    df = spark.createDataFrame(STATES, kinds)
    scores = F.transform(F.filter(F.split("scores", ","), lambda x: x != ""), lambda x: x.cast("bigint"))
    return S.facts(df.withColumn("categories", F.split("categories", ",")).withColumn("scores", scores))


def category_hints(spark, d):
    return states(spark).select("state_id", F.explode("missing").alias("category"))


def reflect_context(spark, d):
    wide = ["candidates", "max_score", "near", "qualified", "n_categories", "words", "clauses"]
    return states(spark).select("state_id", *[F.col(c).cast("bigint").alias(c) for c in wide], F.size("missing").cast("bigint").alias("missing"))


def routing_hint(spark, d):
    return states(spark).select("state_id", "hint")


def route_decide(spark, d):
    few = (F.col("qualified") < D.MIN_RELEVANT) & (F.col("attempts") < D.MAX_ATTEMPTS) & (F.col("reflections") < D.MAX_REFLECTIONS)
    failed = (F.col("fetch_failed") + F.col("score_failed")) > 0
    return states(spark).select("state_id", F.when(~failed & few, "reflect").otherwise("report").alias("route"))


def benchmark(spark):
    return S.run(spark, S.load(Path(__file__).with_name("scenarios.json")))


def scenarios(spark, d):
    found = S.load(Path(__file__).with_name("scenarios.json"))
    rows = [(s["id"], s["kind"], s["query"], ",".join(s["categories"]), len(s["scores"]), s["raw"], s["expected"]["action"], s["expected"]["route"]) for s in found]
    return spark.createDataFrame(rows, "id string, kind string, query string, categories string, n_candidates int, raw string, action string, route string")


def reflect_policy(spark, d):
    return benchmark(spark).select("id", "action", "route", "source", (F.col("action") == F.col("expected")).alias("expected"))


def constraint_check(spark, d):
    return benchmark(spark).select("id", "passed", F.array_join("problems", ",").alias("problems"), "schema_ok", "closed", "closed_ok")


def scenario_metrics(spark, d):
    return S.metrics(benchmark(spark).where("kind IS NOT NULL")).where(~F.col("metric").startswith("always-"))


def static_baselines(spark, d):
    return S.metrics(benchmark(spark)).where(F.col("metric").startswith("always-")).drop("calls")


SINCE, UNTIL, KINDS = datetime(2024, 1, 5), datetime(2024, 1, 12), ["click", "view"]


def scan_window(spark, d):
    return I.scan(table(spark, d, "events"), SINCE, UNTIL, KINDS, "event_type").select("event_id", "ts", "event_type")


def scan_latest(spark, d):
    return I.scan(table(spark, d, "events"), SINCE, UNTIL, KINDS, "event_type", limit=30).select("event_id", "ts", "event_type")


def _raw(pos):
    """Ids as sources write them: with scheme, host and version, some blank."""
    return F.when(pos % 17 == 5, " ").otherwise(F.concat(F.when(pos % 2 == 0, "https://arxiv.org/abs/").otherwise("arXiv: "), F.lit("2401."), pos.cast("string"), F.concat(F.lit("v"), (pos % 3 + 1).cast("string"))))


def merge_new(spark, d):
    """The documents as the pool, a fetch of all of them twice over with later ids, and the labelled ones already seen."""
    p = papers(spark, d).select("pos")
    far = p.select((F.col("pos") + 500).alias("pos"))
    seen = table(spark, d, "labels").select(F.concat(F.lit("2401."), (F.col("doc_id") + 500).cast("string")).alias("paper_key"))
    merged = I.round_of(p, I.attempt(lambda: p.unionByName(far).unionByName(far)), seen, _raw(F.col("pos")), "pos")
    return merged.select("paper_key", F.col("src").cast("bigint").alias("src"), "pos")


def anti_anchor(spark, d):
    p = papers(spark, d)
    return p.select("paper_id").join(p.where(is_anchor(F.col("pos"))).select("paper_id"), "paper_id", "left_anti")


def snapshot_check(spark, d):
    """What two versions of a table do not share, with repeated rows counted."""
    old = table(spark, d, "documents").select("doc_id", "text")
    new = old.withColumn("text", F.when(F.col("doc_id") == 5, "changed").otherwise(F.col("text")))
    new = new.unionByName(new.where("doc_id = 6"))
    part = lambda side, rows: rows.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return part("missing", old.exceptAll(new)).unionByName(part("added", new.exceptAll(old)))


INTEREST = "agents that plan"


def fingerprint(spark, d):
    p = papers(spark, d)
    key = lambda prefix, meta: C.cache_key(prefix, meta, F.lit(INTEREST), F.col("paper_id"), F.col("title"), F.col("summary"))
    return p.select("paper_id", key(C.SCORES, C.SCORER).alias("score_key"), key(C.READINGS, C.READER).alias("reading_key"))


def _cache(spark, d):
    """Scores kept for even ids, some of them not sound."""
    p = papers(spark, d).where("pos % 2 = 0")
    key = C.cache_key(C.SCORES, C.SCORER, F.lit(INTEREST), F.col("paper_id"), F.col("title"), F.col("summary"))
    return p.select(key.alias("cache_key"), F.when(F.col("pos") % 10 == 4, 99).otherwise(F.col("n_chars") % 11).alias("score"), F.when(F.col("pos") % 10 == 6, " ").otherwise(" kept ").alias("reason"))


def cache_filter(spark, d):
    return C.sound(_cache(spark, d))


def cache_misses(spark, d):
    """All papers probed against the sound entries."""
    p = papers(spark, d)
    key = C.cache_key(C.SCORES, C.SCORER, F.lit(INTEREST), F.col("paper_id"), F.col("title"), F.col("summary"))
    return p.select("paper_id", key.alias("cache_key")).join(C.sound(_cache(spark, d)), "cache_key", "left_anti").select("paper_id")


def cached_scores(spark, d):
    """The funnel through the cached scorer."""
    head = R.llm_candidates(spark, d).join(papers(spark, d).select("paper_id", "title", "summary"), "paper_id")
    return C.score_cached(head, _cache(spark, d), INTEREST)[0]


# -- SQL ------------------------------------------------------------------------------------------
VALUES = ", ".join(f"('{c}', '{w}')" for c, words in D.HINTS for w in words)
FACTS = f"""WITH s AS (SELECT {NAMES.replace('categories', "string_split(categories, ',') AS categories").replace('scores,', "list_transform(list_filter(string_split(scores, ','), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS scores,")} FROM {values(STATES)} t({NAMES})),
h AS (SELECT * FROM (VALUES {VALUES}) h(category, word)),
m AS (SELECT DISTINCT state_id, category FROM s, h WHERE NOT list_contains(categories, category) AND regexp_matches(lower(query), '(^|[^a-z0-9])' || word || '($|[^a-z0-9])')),
f AS (SELECT s.*, len(scores) AS candidates, list_max(scores) AS max_score, len(list_filter(scores, lambda x: x >= 4 AND x < 7)) AS near, len(list_filter(scores, lambda x: x >= 7)) AS qualified, len(categories) AS n_categories,
 len(regexp_extract_all(query, '[A-Za-z0-9]+')) AS words, len(list_filter(regexp_split_to_array(query, '[,;.]'), lambda x: trim(x) <> '')) AS clauses, (SELECT count(*) FROM m WHERE m.state_id = s.state_id) AS missing FROM s)"""
RAW = "CASE WHEN pos % 17 = 5 THEN '' ELSE '2401.' || pos END"
P = f"WITH {R.PAPERS}"


def KEY(prefix: str, meta: dict) -> str:
    fields = {**{k: f"'{v}'" for k, v in meta.items()}, "interest": f"'{INTEREST}'", "paper": "{'id': paper_id, 'summary': summary, 'title': title}"}
    return f"'{prefix}' || sha256(CAST(to_json({{{', '.join(f"'{k}': {v}" for k, v in sorted(fields.items()))}}}) AS VARCHAR))"


CACHE = f"cache AS (SELECT pos, {KEY(C.SCORES, C.SCORER)} AS cache_key, n_chars % 11 AS score, 'kept' AS reason FROM papers WHERE pos % 2 = 0 AND pos % 10 NOT IN (4, 6))"
QUERIES = {f.__name__: f for f in (category_hints, reflect_context, routing_hint, route_decide, scenarios, reflect_policy, constraint_check, scenario_metrics, static_baselines, scan_window, scan_latest, merge_new, anti_anchor, snapshot_check, fingerprint, cache_filter, cache_misses, cached_scores)}
IN_WINDOW = "ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12' AND event_type IN ('click', 'view')"
SQL = {
    "category_hints": f"{FACTS} SELECT CAST(state_id AS BIGINT) AS state_id, category FROM m",
    "reflect_context": f"{FACTS} SELECT CAST(state_id AS BIGINT) AS state_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("candidates", "max_score", "near", "qualified", "n_categories", "words", "clauses", "missing")) + " FROM f",
    "routing_hint": f"""{FACTS} SELECT CAST(state_id AS BIGINT) AS state_id, CASE WHEN candidates = 0 AND n_categories >= 4 THEN 'stop' WHEN near > 0 THEN 'refocus' WHEN missing > 0 AND n_categories < 4 THEN 'widen'
 WHEN clauses >= 5 AND words >= 8 THEN 'refocus' WHEN n_categories >= 4 AND coalesce(max_score, 0) <= 3 THEN 'stop' END AS hint FROM f""",
    "route_decide": f"{FACTS} SELECT CAST(state_id AS BIGINT) AS state_id, CASE WHEN fetch_failed = 0 AND score_failed = 0 AND qualified < 3 AND attempts < 3 AND reflections < 3 THEN 'reflect' ELSE 'report' END AS route FROM f",
    "scan_window": f"SELECT event_id, ts, event_type FROM events WHERE {IN_WINDOW}",
    "scan_latest": f"SELECT event_id, ts, event_type FROM events WHERE {IN_WINDOW} ORDER BY ts DESC, event_id LIMIT 30",
    "merge_new": f"""WITH n AS (SELECT pos, {RAW} AS k FROM (SELECT doc_id AS pos FROM documents UNION SELECT doc_id + 500 FROM documents)), i AS (SELECT pos, k FROM n WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE '2401.' || (l.doc_id + 500) = n.k))
SELECT k AS paper_key, CAST(0 AS BIGINT) AS src, pos FROM n WHERE k <> '' AND pos IN (SELECT doc_id FROM documents) UNION ALL SELECT k, 1, pos FROM i WHERE k <> '' AND pos NOT IN (SELECT doc_id FROM documents)""",
    "anti_anchor": "SELECT CAST(doc_id AS VARCHAR) AS paper_id FROM documents WHERE doc_id % 50 <> 7",
    "snapshot_check": """WITH a AS (SELECT doc_id, text FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id = 5 THEN 'changed' ELSE text END AS text FROM documents UNION ALL SELECT doc_id, text FROM documents WHERE doc_id = 6)
SELECT 'missing' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "fingerprint": f"{P} SELECT paper_id, {KEY(C.SCORES, C.SCORER)} AS score_key, {KEY(C.READINGS, C.READER)} AS reading_key FROM papers",
    "cache_filter": f"{P}, {CACHE} SELECT cache_key, score, reason FROM cache",
    "cache_misses": f"{P}, {CACHE} SELECT paper_id FROM papers WHERE pos NOT IN (SELECT pos FROM cache)",
    "cached_scores": f"""{R.HYBRID}, {CACHE}, h AS (SELECT f.rank, p.* FROM fused f JOIN papers p USING (pos) WHERE f.rank <= 30)
SELECT paper_id, h.rank, CAST(coalesce(c.score, length(title) % 11) AS INTEGER) AS score, coalesce(c.reason, 'title length') AS reason, CASE WHEN c.pos IS NULL THEN 'scorer' ELSE 'cache' END AS origin, false AS bad FROM h LEFT JOIN cache c USING (pos)""",
}
