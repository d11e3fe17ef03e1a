"""Validation, decisions, answers, reports and streams, each with its SQL where it has one."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import strict as J
from papyrine.functions import text as T
from papyrine.operators import decision as D
from papyrine.operators import incremental as I
from papyrine.operators.ranking import FUNNEL
from papyrine.plans import evaluation as E
from papyrine.plans import retrieval as R
from papyrine.sources.tables import labels, papers, shared_dir, table

CASES = [(1, "relevant agents for retrieval and planning", "agents, retrieval, planning, vision"), (2, "short", "agents"), (3, "agents, retrieval, planning, vision", "agents, retrieval, planning, vision"), (4, "cooking recipes for lazy weekend afternoons", "agents with retrieval"), (5, "  agents   with   retrieval   and   memory ", "agents with retrieval")]
LINES = [(1, '{"id":1,"score":7,"reason":"fits"}'), (2, '{"id":1,"score":"7","reason":"fits"}'), (3, '{"id":1,"score":999,"reason":"fits"}'), (4, '{"id":1,"score":3}'), (5, "oops"), (6, '{"id":1,"score":true,"reason":"x"}'), (7, '{"id":1,"score":2,"reason":" "}'), (8, '{"id":1,"score":2,"reason":"x"} tail'), (9, '{"id":2,"score":2,"reason":"x"}'), (10, '{"id":1,"score":2.0,"reason":"x"}')]
RAW = [(1, '{"action":"widen","new_categories":["cs.CL"],"why":"x"}'), (2, '{"action":"widen","new_categories":"cs.CL","why":"x"}'), (3, '{"action":"delete","why":"x"}'), (4, '{"action":"refocus","new_query":5,"why":"x"}'), (5, "[1]"), (6, '{"action":"stop","why":"x"}'), (7, '{"action":"stop"}')]
ANSWERS = [(1, "As [1] and [3] show"), (2, "nothing"), (3, "see [9]"), (4, "[2][2] and [10]"), (5, "[01]")]
WIDEN = [(1, "cs.AI,cs.LG", "cs.CL,cs.ZZ,cs.IR,cs.RO"), (2, "cs.AI,cs.LG,cs.CL", "cs.CL,cs.RO,cs.RO"), (3, "cs.AI", "cs.AI")]


def values(rows) -> str:
    cells = lambda r: ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r)
    return "(VALUES " + ", ".join(f"({cells(r)})" for r in rows) + ")"


def frame(spark: SparkSession, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} {'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, rows[0], strict=True)))


def refocus_validate(spark, d):
    return frame(spark, CASES, "id", "q", "current").select("id", T.refocus_ok(F.col("q"), F.col("current"), F.col("current")).alias("valid"))


def score_validate(spark, d):
    """Each line as the whole answer for one row."""
    return frame(spark, LINES, "id", "line").select("id", J.score_line(F.col("line"), 1).alias("valid"))


def decision_validate(spark, d):
    return frame(spark, RAW, "id", "raw").select("id", J.decision(F.col("raw")).alias("valid"))


def widen_categories(spark, d):
    asked = F.array_distinct(F.split("asked", ","))
    allowed = F.filter(asked, lambda c: c.isin(*sorted(D.ALLOWED)) & ~F.array_contains(F.split("current", ","), c))
    return frame(spark, WIDEN, "id", "current", "asked").select("id", F.array_join(F.sort_array(F.slice(allowed, 1, 2)), ",").alias("added"))


def array_sets(spark, d):
    a, b = F.split("current", ","), F.split("asked", ",")
    join = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return frame(spark, WIDEN, "id", "current", "asked").select("id", join(F.array_union(a, b)).alias("either"), join(F.array_intersect(a, b)).alias("both"), join(F.array_except(b, a)).alias("new"), (F.size(F.array_except(b, a)) == 0).alias("subset"))


def qa_citations(spark, d):
    cited = T.citations(F.col("answer"))
    valid = (F.size(cited) > 0) & (F.size(F.array_except(cited, F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint")))) == 0)
    return frame(spark, ANSWERS, "id", "answer").select("id", F.size(cited).cast("bigint").alias("n"), valid.alias("valid"))


QA_TOP, QA_GATE = 10, 0.35


def qa_gate(spark, d):
    """The head of the fused ranking, of it those near enough to the question's vector."""
    top = R.hybrid(spark, d).where(F.col("rank") <= QA_TOP).select("pos", "rank")
    sims = R.dense(spark, d).select(F.col("vec_id").alias("pos"), F.round("sim", 6).alias("sim"))
    return top.join(sims, "pos").where(F.col("sim") >= QA_GATE).select("pos", "rank", "sim")


def qa_context(spark, d):
    """The records that an answer may cite, numbered after the gate, a JSON line each."""
    gate = qa_gate(spark, d).join(papers(spark, d), "pos")
    n = F.row_number().over(Window.orderBy("rank")).cast("bigint")  # QA_TOP rows at most
    gate = gate.withColumn("source_id", n)
    return gate.select("source_id", "paper_id", F.to_json(F.struct("source_id", "title", "summary")).alias("line"))


def candidate_json(spark, d):
    p = papers(spark, d).where("lang = 'en'")
    cut = {"title": ("title", 500), "abstract": ("summary", 1000)}
    texts = [T.collapse_ws(F.col(c), n).alias(name) for name, (c, n) in cut.items()]
    reason = T.collapse_ws(F.lit("frozen"), 300).alias("ranking_reason")
    categories = F.slice(F.array_compact(F.array("category")), 1, 10).alias("categories")
    fields = F.to_json(F.struct((F.col("n_chars") % 11).alias("score"), *texts, reason, categories), {"ignoreNullFields": "false"})
    return p.select("paper_id", T.safe_json(fields).alias("json"))


def normalize_id(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_id(F.col("url")).alias("key"))


def review_list(spark, d):
    p = papers(spark, d)
    ranked = R.hybrid(spark, d).join(p, "pos").join(labels(spark, d), "paper_id", "left")
    label, score = F.coalesce("label", F.lit("-")), F.when(F.col("rank") <= FUNNEL, F.col("n_chars") % 11)  # only the head is scored
    star = ((F.col("rank") <= 30) & (label != "rel")) | F.coalesce(score.isin(6, 7), F.lit(False))
    return ranked.select("rank", "paper_id", label.alias("label"), score.alias("score"), star.alias("star"), F.translate("title", "|\n", "/ ").alias("title"))


def report_lines(spark, d):
    top = E.rank_final(spark, d)
    head = F.when(F.col("score") >= 7, "recommended").otherwise("exploration")
    return top.select("rank", F.concat_ws(" ", F.format_string("%d.", "rank"), head, "paper_id").alias("line"))


def scan_status(spark, d):
    """A window without rows is not a failed fetch."""
    events = table(spark, d, "events")
    found = {"empty": I.attempt(lambda: events.where("false")), "rows": I.attempt(lambda: events), "failed": I.attempt(lambda: {}["no source"])}
    parts = [o.rows.agg(F.lit(k).alias("kind"), F.lit(True).alias("ok"), F.count("*").alias("n")) if o.ok else spark.createDataFrame([(k, False, 0)], "kind string, ok boolean, n long") for k, o in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def blind_sample(spark, d):
    p = papers(spark, d).join(labels(spark, d), "paper_id", "left_anti")
    return p.orderBy(F.sha2(F.concat_ws(":", F.lit("2026"), "paper_id"), 256)).limit(18).orderBy("pos").select("pos", "paper_id", "title")


def stream_dedup(spark, d):
    from papyrine.streaming.ingest import ingest

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    ingest(spark, d, events.schema, f"{at}/store", f"{at}/checkpoint", pattern="events.parquet")
    return spark.read.parquet(f"{at}/store").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def file_sha(spark, d):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{d}/region.parquet")
    return files.select(F.sha2("content", 256).alias("sha256"), "length")


ALLOWED = ", ".join(f"'{c}'" for c in sorted(D.ALLOWED))
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
NORM = "lower(regexp_replace(regexp_replace(rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(url, '')), '^arxiv:\\s*', '', 'i'), '^https?://(export\\.)?arxiv\\.org/(abs|pdf)/', '', 'i'), '\\?.*$', '', 's'), '#.*$', '', 's'), '/'), '\\.pdf$', '', 'i'), 'v\\d+$', '', 'i'))"
QUERIES = {f.__name__: f for f in (refocus_validate, score_validate, decision_validate, widen_categories, array_sets, qa_citations, qa_gate, qa_context, candidate_json, normalize_id, review_list, report_lines, scan_status, blind_sample, stream_dedup, file_sha)}
TERMS = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda t: t NOT IN ({STOP}))"
SQL = {
    "refocus_validate": f"""SELECT CAST(id AS BIGINT) AS id, length(f) BETWEEN 20 AND 500 AND len(string_split(f, ' ')) <= 80 AND lower(f) <> lower(current) AND len(regexp_extract_all(f, '[A-Za-z]')) >= 10
 AND len(list_intersect({TERMS('f')}, {TERMS('current')})) >= least(2, len({TERMS('current')})) AS valid FROM (SELECT id, current, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS f FROM {values(CASES)} t(id, q, current))""",
    "score_validate": f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN false ELSE list_sort(json_keys(line)) = ['id', 'reason', 'score'] AND json_type(line, '$.id') = 'UBIGINT'
 AND json_type(line, '$.score') = 'UBIGINT' AND json_type(line, '$.reason') = 'VARCHAR' AND TRY_CAST(line ->> '$.id' AS BIGINT) = 1 AND TRY_CAST(line ->> '$.score' AS BIGINT) BETWEEN 0 AND 10 AND trim(line ->> '$.reason') <> '' END AS valid FROM {values(LINES)} t(id, line)""",
    "decision_validate": f"""SELECT CAST(id AS BIGINT) AS id, coalesce(CASE WHEN NOT json_valid(raw) OR json_type(raw) <> 'OBJECT' THEN false ELSE json_type(raw, '$.why') = 'VARCHAR' AND CASE raw ->> '$.action' WHEN 'stop' THEN true
 WHEN 'refocus' THEN json_type(raw, '$.new_query') = 'VARCHAR' WHEN 'widen' THEN json_type(raw, '$.new_categories') = 'ARRAY' AND len(list_filter(CAST(json_extract(raw, '$.new_categories[*]') AS JSON[]), lambda c: json_type(c) <> 'VARCHAR')) = 0 ELSE false END END, false) AS valid FROM {values(RAW)} t(id, raw)""",
    "widen_categories": f"""WITH t AS (SELECT * FROM {values(WIDEN)} t(id, current, asked)), u AS (SELECT id, current, unnest(string_split(asked, ',')) AS c, generate_subscripts(string_split(asked, ','), 1) AS i FROM t),
k AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS n FROM u WHERE c IN ({ALLOWED}) AND NOT list_contains(string_split(current, ','), c) GROUP BY id, c)
SELECT CAST(t.id AS BIGINT) AS id, coalesce(string_agg(c, ',' ORDER BY c), '') AS added FROM t LEFT JOIN k ON k.id = t.id AND n <= 2 GROUP BY t.id""",
    "array_sets": f"""WITH t AS (SELECT id, string_split(current, ',') AS a, string_split(asked, ',') AS b FROM {values(WIDEN)} t(id, current, asked))
SELECT CAST(id AS BIGINT) AS id, array_to_string(list_sort(list_distinct(a || b)), ',') AS either, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ',') AS "both",
 array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), ',') AS new, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM t""",
    "qa_citations": f"""SELECT CAST(id AS BIGINT) AS id, CAST(len(c) AS BIGINT) AS n, len(c) > 0 AND len(list_filter(c, lambda x: x NOT BETWEEN 1 AND 5)) = 0 AS valid
 FROM (SELECT id, list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT))) AS c FROM {values(ANSWERS)} t(id, answer))""",
    "qa_gate": f"{R.HYBRID} SELECT pos, fused.rank, round(sim, 6) AS sim FROM fused JOIN dense ON vec_id = pos WHERE fused.rank <= 10 AND round(sim, 6) >= 0.35",
    "qa_context": f"""{R.HYBRID}, g AS (SELECT row_number() OVER (ORDER BY f.rank) AS source_id, f.pos FROM fused f JOIN dense ON vec_id = f.pos WHERE f.rank <= 10 AND round(sim, 6) >= 0.35)
SELECT source_id, paper_id, CAST(to_json({{'source_id': source_id, 'title': title, 'summary': summary}}) AS VARCHAR) AS line FROM g JOIN papers USING (pos)""",
    "candidate_json": f"""WITH {R.PAPERS}, f AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS a FROM papers WHERE lang = 'en')
SELECT paper_id, replace(replace('{{"score":' || n_chars % 11 || ',"title":' || CAST(to_json(substring(t, 1, 500)) AS VARCHAR) || ',"abstract":' || CAST(to_json(substring(a, 1, 1000)) AS VARCHAR)
 || ',"ranking_reason":"frozen","categories":["' || category || '"]}}', '<', '\\u003c'), '>', '\\u003e') AS json FROM f""",
    "normalize_id": f"SELECT page_id, {NORM} AS key FROM pages",
    "review_list": f"""{R.HYBRID}, {E.L} SELECT rank, paper_id, coalesce(label, '-') AS label, CASE WHEN rank <= 30 THEN n_chars % 11 END AS score, rank <= 30 AND (coalesce(label, '-') <> 'rel' OR n_chars % 11 IN (6, 7)) AS star, translate(title, '|' || chr(10), '/ ') AS title
 FROM fused JOIN papers USING (pos) LEFT JOIN lab USING (paper_id)""",
    "blind_sample": f"""WITH {R.PAPERS}, {E.L} SELECT pos, paper_id, title FROM papers p WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.paper_id = p.paper_id) ORDER BY sha256('2026:' || paper_id) LIMIT 18""",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS ids FROM events WHERE event_id IS NOT NULL GROUP BY event_type",
    "scan_status": "SELECT 'empty' AS kind, true AS ok, 0::BIGINT AS n UNION ALL SELECT 'rows', true, count(*) FROM events UNION ALL SELECT 'failed', false, 0",
    "report_lines": f"{E.FINAL} SELECT rank, rank || '. ' || CASE WHEN score >= 7 THEN 'recommended' ELSE 'exploration' END || ' ' || paper_id AS line FROM fin",
}
