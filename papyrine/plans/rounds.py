"""The paged source, replayable rounds, feedback and what it feeds, recall for many queries, keywords in texts, drawn baselines; each with its SQL."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from papyrine.functions import strict as J
from papyrine.functions import text as T
from papyrine.operators import feedback as B
from papyrine.operators import incremental as I
from papyrine.operators import labelling
from papyrine.operators import metrics as M
from papyrine.operators import providers as P
from papyrine.operators import report
from papyrine.operators import retrieval as O
from papyrine.operators.statistics import Statistics
from papyrine.plans import evaluation as E
from papyrine.plans import retrieval as R
from papyrine.plans.agent import IN_WINDOW, KINDS, SINCE, UNTIL
from papyrine.sources import documents, paged
from papyrine.sources.tables import checkpointed, labels, papers, shared_dir, table
from papyrine.streaming.rounds import Rounds, follow


def state_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def events_source(spark, d, **asked) -> DataFrame:
    return paged.fetch(spark, f"{d}/events.parquet", kind="event_type", **asked)


def source_window(spark, d):
    """The scan of a window, through the paged source."""
    return events_source(spark, d, since=SINCE, until=UNTIL, kinds=KINDS, columns=["event_id", "ts", "event_type"]).select("event_id", "ts", "event_type")


def source_latest(spark, d):
    """Without a window: the newest first."""
    return events_source(spark, d, kinds=KINDS, columns=["event_id", "ts", "event_type"]).orderBy(F.desc("ts"), "event_id").limit(30).select("event_id", "ts", "event_type")


def source_status(spark, d):
    """A window with rows, one without, one that ends before it begins and a source that is not there."""
    asks = {
        "rows": {"since": SINCE, "until": UNTIL},
        "empty": {"since": datetime(1999, 1, 1), "until": datetime(1999, 1, 2)},
        "reversed": {"since": UNTIL, "until": SINCE},
        "unknown client": {"client": "papyrine.sources.paged:NoClient"},
    }
    found = {k: I.attempt(lambda a=a: events_source(spark, d, columns=["ts"], **a)) for k, a in asks.items()}
    parts = [o.rows.agg(F.lit(k).alias("kind"), F.lit(True).alias("ok"), F.count("*").alias("n")) if o.ok else spark.createDataFrame([(k, False, 0)], "kind string, ok boolean, n long") for k, o in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FIRSTS = StructType([StructField("paper_key", StringType()), StructField("event_id", LongType()), StructField("ts", TimestampNTZType())])


def stream_rounds(spark, d):
    """The events as a stream of three-day windows; the first of each user and type, as the store holds them in the end."""
    stream = paged.stream(spark, f"{d}/events.parquet", kind="event_type", step_seconds=3 * 86_400, columns=["event_id", "ts", "user_id", "event_type"])
    rows = stream.select(F.concat_ws(":", "user_id", "event_type").alias("paper_key"), "event_id", "ts")
    rounds = Rounds(spark, state_path(spark, "rounds"), FIRSTS, "paper_key", "ts", ("event_id",))
    follow(rows, rounds)
    return rounds.store.read().select("paper_key", "event_id", "ts")


def votes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Clicks and errors as votes up and down on the paper of the user's number, and the texts of the papers they are on."""
    label = F.when(F.col("event_type") == "click", "up").otherwise("down")
    cast = table(spark, d, "events").where("event_type IN ('click', 'error')").select("event_id", F.col("user_id").alias("pos"), label.alias("label"), F.col("ts").alias("at"))
    p = papers(spark, d).join(cast.select("pos").distinct(), "pos", "left_semi")
    p = checkpointed(p.select("pos", "paper_id", B.text_key(F.col("title"), F.col("summary")).alias("text"), "title", "summary"))
    found = cast.join(p.select("pos", "paper_id", "text"), "pos").select("event_id", "paper_id", "text", "label", "at")
    return found, p.select("text", "title", "summary").dropDuplicates(["text"])


def feedback(spark, d) -> B.Feedback:
    """All votes, taken in three batches by time, the middle one last and once again."""
    found, texts = votes(spark, d)
    all_ = checkpointed(found)
    first, last = all_.agg(F.min("at"), F.max("at")).first()
    kept = B.Feedback(spark, state_path(spark, "feedback"))
    if first is None:
        return kept
    a, b = first + (last - first) / 3, first + (last - first) * 2 / 3
    a, b = a - timedelta(microseconds=a.microsecond), b - timedelta(microseconds=b.microsecond)
    at = F.col("at")
    for n, part in enumerate((at < a, at >= b, (at >= a) & (at < b))):
        kept.record(all_.where(part), n, texts)
    kept.record(all_.where(at < a), 2, texts)
    return kept


def feedback_state(spark, d):
    return feedback(spark, d).newest.read().select("paper_id", "label", "at", "event_id")


def feedback_anchors(spark, d):
    return feedback(spark, d).anchor_digests().select("sign", F.col("anchor_digest").alias("anchor"), "papers")


def feedback_excluded(spark, d):
    """Papers that an evaluation may use: those without feedback."""
    return papers(spark, d).select("paper_id").join(feedback(spark, d).voted(), "paper_id", "left_anti")


def feedback_bonus(spark, d):
    """Every vector's bonus by the vectors of all papers with feedback."""
    e = table(spark, d, "embeddings")
    sign = F.when(F.col("label") == "up", 1).otherwise(-1)
    state = feedback(spark, d).newest.read().select(F.col("paper_id").cast("long").alias("vec_id"), sign.alias("sign"))
    anchors = e.join(state, "vec_id").select("sign", "embedding")
    return B.bonus(e, anchors).select("vec_id", F.round("bonus", 6).alias("bonus"))


def anchor_owners(spark, d):
    """Anchors of old, kept as bare text: a title, a text, or a title with another abstract; and the papers they belong to."""
    p = papers(spark, d)
    kind = F.col("pos") % 3
    old = F.when(kind == 0, F.col("title")).when(kind == 1, B.anchor_text(F.col("title"), F.col("summary"))).otherwise(F.concat("title", F.lit(". An abstract of old.")))
    found = B.owner_digests(p.select(old.alias("anchor")), p.select("paper_id", "title"))
    return found.select(F.col("digest").alias("anchor"), "paper_id")


def dense_recall(spark, d):
    """The ten documents nearest to each benchmark text, by embedding both."""
    embed = lambda df, key, text: df.select(key, P.embedded(F.col(text), lambda: P.embed_words).alias("embedding"))
    docs = embed(papers(spark, d).select("pos", R.text().alias("t")), "pos", "t")
    asks = embed(table(spark, d, "benchmark"), "item_id", "text")
    return O.dense_many(docs, asks, 10).select("item_id", "pos", F.round("sim", 6).alias("sim"), "rank")


def category_texts(spark, d):
    """The documents that hold the first one, two or three words of a benchmark text, standing alone; each text's words are a category's keywords."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.array(*[F.array_join(F.slice(runs, 1, n), " ") for n in (1, 2, 3)])).alias("word")).where("word <> ''")
    return T.keyword_hits(papers(spark, d), "pos", "summary", words).select("pos", "item_id", "word").distinct()


def random_draws(spark, d):
    """The random baseline, by positions drawn for each trial."""
    m = M.judged(M.drawn_trials(papers(spark, d), E.TRIALS_DRAWN, 10, 42), labels(spark, d), 10, "trial")
    return E.rounded(m.select("trial", "precision", "recall", "coverage"))


def refocus_texts(spark, d):
    """Every pair of neighbouring turns of a conversation: may the later text stand in for the earlier one as a query?"""
    turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = table(spark, d, "conversations").withColumn("current", F.lag("text").over(turn)).where("current IS NOT NULL AND text IS NOT NULL")
    valid = T.refocus_ok(F.col("text"), F.col("current"), F.col("current"))
    return c.groupBy("conv_id").agg(F.count("*").alias("pairs"), F.count_if(valid).alias("valid"))


def citation_texts(spark, d):
    """Every document as an answer that cites two numbers behind its text; whether all it cites are of the records 1 to 5."""
    p = papers(spark, d)
    answer = F.concat(F.coalesce("summary", F.lit("")), F.lit(" ["), (F.col("pos") % 7).cast("string"), F.lit("] and ["), (F.col("n_chars") % 6).cast("string"), F.lit("]"))
    p = p.select("pos", T.citations(answer).alias("c"))
    return p.select("pos", F.size("c").cast("bigint").alias("n"), F.forall("c", lambda x: x.between(1, 5)).alias("valid"))


# Lines and decisions as a model may write them, with places for an event's number and type.
LINES = [
    '{"id":1,"score":#,"reason":"@"}', '{"score":#, "reason":"@","id":2}', '{"id":3,"score":#,"reason":"@"}', '{"id":1,"score":#.0,"reason":"@"}', '{"id":1,"score":"#","reason":"@"}', '{"id":true,"score":#,"reason":"@"}',
    '{"id":1,"score":#,"reason":" "}', '{"id":1,"score":#,"reason":"@"} tail', '{"id":1,"score":#,"reason":"@"}}', '[{"id":1,"score":#,"reason":"@"}]', '{"id":1,"score":#}', '{"id":1,"score":#,"reason":"@","more":1}', '@', '',
]
CHOICES = [
    '{"action":"stop","why":"@"}', '{"action":"stop","why":#}', '{"action":"refocus","new_query":"@","why":"@","more":[#]}', '{"action":"refocus","new_query":#,"why":"@"}', '{"action":"widen","new_categories":["@"],"why":"@"}',
    '{"action":"widen","new_categories":[],"why":"@"}', '{"action":"widen","new_categories":["@",#],"why":"@"}', '{"action":"widen","new_categories":"@","why":"@"}', '{"action":"@","why":"@"}', '{"action":"stop","why":"@"},', '[#]', '{"why":"@"}',
]


def _written(spark, d, forms: list[str]):
    """Each event's line in one of the forms."""
    n = F.col("event_id") % len(forms)
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (n + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.replace(F.replace(form, F.lit("#"), (F.floor(F.col("event_id") / len(forms)) % 13).cast("string")), F.lit("@"), F.col("event_type")).alias("line"))


def score_lines(spark, d):
    return _written(spark, d, LINES).select("event_id", J.score_line(F.col("line"), 2).alias("valid"))


def decision_lines(spark, d):
    return _written(spark, d, CHOICES).select("event_id", J.decision(F.col("line")).alias("valid"))


# -- SQL ------------------------------------------------------------------------------------------
VOTES = "v AS (SELECT event_id, CAST(d.doc_id AS VARCHAR) AS paper_id, split_part(d.text, '.', 1) AS title, d.text AS summary, CASE event_type WHEN 'click' THEN 'up' ELSE 'down' END AS label, ts AS \"at\" FROM events e JOIN documents d ON d.doc_id = e.user_id WHERE event_type IN ('click', 'error'))"
STATE = f"{VOTES}, st AS (SELECT *, CASE WHEN coalesce(summary, '') = '' THEN title ELSE title || '. ' || summary END AS anchor FROM v QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY \"at\" DESC, event_id DESC) = 1)"
EMBED = lambda name, key, text, source: f"""{name}t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}), {name}c AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS dim, count(*)::DOUBLE AS n FROM {name}t GROUP BY ALL),
{name}n AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}c GROUP BY {key})"""  # noqa: E731
DRAWS = f"""WITH {R.PAPERS}, {E.L}, nu AS (SELECT paper_id, row_number() OVER (ORDER BY paper_id) AS pl, count(*) OVER () AS n FROM papers), g AS (SELECT t.trial, j.j, sha256('42:' || t.trial || ':' || j.j) AS h, (SELECT max(n) FROM nu) AS n
 FROM (SELECT unnest(range({E.TRIALS_DRAWN})) AS trial) t, (SELECT unnest(range(greatest(80, least(200, (SELECT count(*) FROM papers))))) AS j) j),
big AS (SELECT trial, CAST('0x' || substr(h, 1, 15) AS BIGINT) % n + 1 AS pl, min(j) AS o FROM g WHERE n >= 80 AND j < 80 GROUP BY ALL),
tr AS (SELECT b.trial, nu.paper_id, row_number() OVER (PARTITION BY b.trial ORDER BY b.o) AS rank FROM big b JOIN nu USING (pl)), {E.JUDGED('tr', 10, 'trial')}"""
QUERIES = {f.__name__: f for f in (source_window, source_latest, source_status, stream_rounds, feedback_state, feedback_anchors, feedback_excluded, feedback_bonus, anchor_owners, dense_recall, category_texts, random_draws, refocus_texts, citation_texts, score_lines, decision_lines)}
FLAT = lambda x: f"trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x{{85}}\\x0b]+', ' ', 'g'))"
_TERMS = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda t: t NOT IN ({', '.join(f"'{w}'" for w in T.STOPWORDS)}))"
def WRITTEN(forms: list[str]) -> str:
    listed = ", ".join("'" + f.replace("'", "''") + "'" for f in forms)
    return f"w AS (SELECT event_id, replace(replace(([{listed}])[event_id % {len(forms)} + 1], '#', CAST(event_id // {len(forms)} % 13 AS VARCHAR)), '@', event_type) AS line FROM events)"


SQL = {
    "score_lines": f"""WITH {WRITTEN(LINES)} SELECT event_id, CASE WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN false ELSE coalesce(list_sort(json_keys(line)) = ['id', 'reason', 'score'] AND json_type(line, '$.id') = 'UBIGINT'
 AND json_type(line, '$.score') = 'UBIGINT' AND json_type(line, '$.reason') = 'VARCHAR' AND TRY_CAST(line ->> '$.id' AS BIGINT) BETWEEN 1 AND 2 AND TRY_CAST(line ->> '$.score' AS BIGINT) BETWEEN 0 AND 10 AND trim(line ->> '$.reason') <> '', false) END AS valid FROM w""",
    "decision_lines": f"""WITH {WRITTEN(CHOICES)} SELECT event_id, coalesce(CASE WHEN NOT json_valid(line) OR json_type(line) <> 'OBJECT' THEN false ELSE json_type(line, '$.why') = 'VARCHAR' AND CASE line ->> '$.action' WHEN 'stop' THEN true
 WHEN 'refocus' THEN json_type(line, '$.new_query') = 'VARCHAR' WHEN 'widen' THEN json_type(line, '$.new_categories') = 'ARRAY' AND len(list_filter(CAST(json_extract(line, '$.new_categories[*]') AS JSON[]), lambda c: json_type(c) <> 'VARCHAR')) = 0 ELSE false END END, false) AS valid FROM w""",
    "source_window": f"SELECT event_id, ts, event_type FROM events WHERE {IN_WINDOW}",
    "source_latest": "SELECT event_id, ts, event_type FROM events WHERE event_type IN ('click', 'view') ORDER BY ts DESC, event_id LIMIT 30",
    "source_status": "SELECT 'rows' AS kind, true AS ok, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12' UNION ALL SELECT * FROM (VALUES ('empty', true, 0), ('reversed', false, 0), ('unknown client', false, 0))",
    "stream_rounds": "SELECT user_id || ':' || event_type AS paper_key, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "feedback_state": f"WITH {STATE} SELECT paper_id, label, \"at\", event_id FROM st",
    "feedback_anchors": f"WITH {STATE} SELECT CASE label WHEN 'up' THEN 1 ELSE -1 END AS sign, sha256(anchor) AS anchor, count(*) AS papers FROM st GROUP BY 1, 2",
    "feedback_excluded": f"WITH {VOTES} SELECT CAST(doc_id AS VARCHAR) AS paper_id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT paper_id FROM v)",
    "feedback_bonus": f"""WITH {STATE}, an AS (SELECT e.embedding, CASE st.label WHEN 'up' THEN 1 ELSE -1 END AS s FROM st JOIN embeddings e ON CAST(st.paper_id AS BIGINT) = e.vec_id)
SELECT vec_id, round(coalesce(avg(sim) FILTER (s = 1), 0) - coalesce(avg(sim) FILTER (s = -1), 0), 6) AS bonus FROM (SELECT e.vec_id, a.s, {R.COS.format(a='e.embedding', b='a.embedding')} AS sim FROM embeddings e LEFT JOIN an a ON true) GROUP BY vec_id""",
    "anchor_owners": f"""WITH {R.PAPERS}, an AS (SELECT DISTINCT CASE pos % 3 WHEN 0 THEN title WHEN 1 THEN CASE WHEN coalesce(summary, '') = '' THEN title ELSE title || '. ' || summary END ELSE title || '. An abstract of old.' END AS anchor FROM papers)
SELECT DISTINCT sha256(anchor) AS anchor, paper_id FROM an JOIN papers p ON anchor = title OR anchor = CASE WHEN coalesce(summary, '') = '' THEN title ELSE title || '. ' || summary END OR starts_with(anchor, title || '. ')""",
    "dense_recall": f"""WITH {R.PAPERS}, {EMBED('d', 'pos', "title || '. ' || summary", 'papers')}, {EMBED('q', 'item_id', 'text', 'benchmark')},
s AS (SELECT item_id, pos, sum(a.n * b.n) AS dot FROM qc a JOIN dc b USING (dim) GROUP BY item_id, pos),
r AS (SELECT b.item_id, p.pos, round(coalesce(dot / (qn.norm * dn.norm), 0), 9) AS sim FROM benchmark b CROSS JOIN papers p LEFT JOIN s ON s.item_id = b.item_id AND s.pos = p.pos LEFT JOIN qn ON qn.item_id = b.item_id LEFT JOIN dn ON dn.pos = p.pos)
SELECT item_id, pos, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, pos) AS rank FROM r) WHERE rank <= 10""",
    "category_texts": """WITH r AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark), h AS (SELECT DISTINCT item_id, array_to_string(ws[1:n], ' ') AS word FROM r, (VALUES (1), (2), (3)) t(n) WHERE len(ws) > 0),
u AS (SELECT DISTINCT word FROM h), m AS (SELECT doc_id AS pos, word FROM documents, u WHERE contains(lower(text), word) AND regexp_matches(lower(text), '(^|[^a-z0-9])' || word || '($|[^a-z0-9])'))
SELECT DISTINCT pos, item_id, word FROM m JOIN h USING (word)""",
    "random_draws": f"{DRAWS} SELECT trial, precision, recall, coverage FROM jm",
    "citation_texts": """SELECT pos, CAST(len(c) AS BIGINT) AS n, len(list_filter(c, lambda x: x NOT BETWEEN 1 AND 5)) = 0 AS valid
 FROM (SELECT doc_id AS pos, list_distinct(list_transform(regexp_extract_all(coalesce(text, '') || ' [' || doc_id % 7 || '] and [' || n_chars % 6 || ']', '\\[(\\d+)\\]', 1), lambda x: CAST(x AS BIGINT))) AS c FROM documents)""",
    "refocus_texts": f"""WITH c AS (SELECT conv_id, {FLAT('text')} AS f, current FROM (SELECT conv_id, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS current FROM conversations) WHERE current IS NOT NULL AND text IS NOT NULL)
SELECT conv_id, count(*) AS pairs, count(*) FILTER (length(f) BETWEEN 20 AND 500 AND len(string_split(f, ' ')) <= 80 AND lower(f) <> lower({FLAT('current')}) AND len(regexp_extract_all(f, '[A-Za-z]')) >= 10
 AND len(regexp_extract_all(f, '[A-Za-z]')) >= 0.8::DOUBLE * length(regexp_replace(f, '[^\\p{{L}}]', '', 'g')) AND len(list_intersect({_TERMS('f')}, {_TERMS('current')})) >= least(2, len({_TERMS('current')}))) AS valid FROM c GROUP BY conv_id""",
}


# -- statistics of a growing store, snapshot documents ----------------------------------------------
def _statistics(spark, d) -> Statistics:
    """The documents' statistics, added in three rounds, the second one twice."""
    p = papers(spark, d)
    kept = Statistics(spark, state_path(spark, "statistics"))
    top = p.agg(F.max("pos")).first()[0] or 0
    for n, (low, high) in enumerate(((0, top // 3), (top // 3, top // 2), (top // 2, top + 1))):
        for _ in range(1 + (n == 1)):
            kept.add(p.where(F.col("pos").between(low, high - 1)), R.text(), n)
    return kept


def statistics_rounds(spark, d):
    return _statistics(spark, d).idf().select("term", "df", F.round("idf", 6).alias("idf"))


def statistics_rank(spark, d):
    """English documents ranked under the whole store's statistics."""
    p = papers(spark, d).where("lang = 'en'")
    return _statistics(spark, d).rank(p, R.text(), R.question(spark, d)).select(F.col("pos").cast("string").alias("paper_id"), F.round("score", 6).alias("score"), "rank")


def snapshot_ranges(spark, d):
    """A snapshot written as a document and read back: its ranges and their hashes."""
    path = state_path(spark, "snapshot")
    documents.write(E.snap(spark, d), path, "1")
    return documents.ranges_of(documents._numbered(documents.read(spark, path)), 100).select("at", "first", "last", "n", "h")


QUERIES |= {f.__name__: f for f in (statistics_rounds, statistics_rank, snapshot_ranges)}
SQL |= {
    "statistics_rounds": R.SQL["bm25_stats"],
    "statistics_rank": R.SQL["bm25_bg"],
    "snapshot_ranges": f"""{E.SNAP}, l AS (SELECT x.id AS id, sha256(CAST(to_json(x) AS VARCHAR)) AS h FROM (SELECT {{'id': id, 'title': title, 'summary': summary, 'label': label, 'is_anchor': is_anchor, 'score': score, 'reason': reason, 'split': split}} AS x FROM snap)),
n AS (SELECT *, row_number() OVER (ORDER BY id, h) - 1 AS pl FROM l)
SELECT pl // 100 AS "at", min(id) AS first, max(id) AS last, count(*) AS n, sha256(string_agg(h, '' ORDER BY pl)) AS h FROM n GROUP BY 1""",
}


# -- the report ---------------------------------------------------------------------------------------
def _reader(paper: dict) -> str:
    """Stands in for a model: the title's length; it fails for some and says nothing for others."""
    n = len(paper["title"])
    if n % 5 == 0:
        raise KeyError("no answer")
    return "" if n % 5 == 1 else f"title of {n} characters"


TRACE = ({"reflection": 1, "action": "widen", "source": "model", "reason": "few found"}, {"reflection": 2, "action": "stop"})


def report_full(spark, d):
    """The final ranking's report."""
    names = papers(spark, d).select("paper_id", F.translate("title", "\n", " ").alias("title"), "summary")
    top = E.rank_final(spark, d).join(names, "paper_id").withColumn("reason", F.concat(F.lit("rank "), F.col("rank").cast("string")))
    return report.report(top, report.Facts("2024-02-01", ("a", "b", "a"), stop_reason="enough", trace=TRACE), _reader)


QUERIES["report_full"] = report_full
_READ = f"CASE length(title) % 5 WHEN 0 THEN '{report.READ_FAILED.format('KeyError')}' WHEN 1 THEN '{report.READ_EMPTY}' ELSE 'title of ' || length(title) || ' characters' END"
SQL["report_full"] = f"""{E.FINAL}, t AS (SELECT f.paper_id, translate(p.title, chr(10), ' ') AS title, CAST(f.score AS BIGINT) AS score, f.rank, f.score >= 7 AS good, row_number() OVER (PARTITION BY f.score >= 7 ORDER BY f.rank) AS place FROM fin f JOIN papers p USING (paper_id))
SELECT 0 AS section, 0 AS n, '# Report of 2024-02-01' AS line UNION ALL SELECT 0, 1, 'Categories: a, b | recommended ' || count(*) FILTER (good) || ' | to explore ' || count(*) FILTER (NOT good) || ' | scores passed' FROM t
UNION ALL SELECT * FROM (VALUES (1, 0, '> Stopped: enough'), (1, 1, '## Trace'), (1, 2, '- reflection 1: `widen` (model) few found'), (1, 3, '- reflection 2: `stop` (unknown) '), (2, 0, '## Recommended'))
UNION ALL SELECT 2, 1, '**Nothing: no paper reaches 7 of 10.**' FROM t HAVING count(*) FILTER (good) = 0 UNION ALL SELECT 4, 0, '## To explore' FROM t HAVING count(*) FILTER (NOT good) > 0
UNION ALL SELECT 3, CAST(place * 10 + i AS INTEGER), CASE i WHEN 0 THEN '## ' || place || '. [' || score || '/10] ' || title WHEN 1 THEN '**Why**: rank ' || rank WHEN 2 THEN {_READ} ELSE '<' || paper_id || '>' END FROM t, (VALUES (0), (1), (2), (3)) v(i) WHERE good
UNION ALL SELECT 5, CAST(place * 10 + i AS INTEGER), CASE i WHEN 0 THEN '### E' || place || '. [' || score || '/10] ' || title WHEN 1 THEN '**Why not**: rank ' || rank ELSE '<' || paper_id || '>' END FROM t, (VALUES (0), (1), (2)) v(i) WHERE NOT good"""


# -- labels by row, counts of a snapshot --------------------------------------------------------------
def _judgments(spark, d):
    """The documents as shown, and a judgment of each event: some of rows that there are not, some with labels that there are not."""
    shown = papers(spark, d).select("paper_id", (F.col("pos") + 1).alias("row_no"))
    label = F.when(F.col("event_type") == "click", "rel").when(F.col("event_type") == "view", "irrel").when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type"))
    asked = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 9 - 3).alias("row_no"), label.alias("label"))
    return labelling.judged_rows(shown, asked)


def label_rows(spark, d):
    return labelling.applied(labels(spark, d), _judgments(spark, d)[0])


def label_refused(spark, d):
    return _judgments(spark, d)[1]


def snapshot_totals(spark, d):
    """Records by label and split, with pairs that there are none of."""
    pairs = [(a, b) for a in ("rel", "irrel", "unjudged") for b in ("anchor", "dev", "test", "unjudged")]
    found = E.snap(spark, d).groupBy(F.coalesce("label", F.lit("unjudged")).alias("label"), "split").agg(F.count("*").alias("n"))
    return spark.createDataFrame(pairs, "label string, split string").join(found, ["label", "split"], "left").select("label", "split", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES |= {f.__name__: f for f in (label_rows, label_refused, snapshot_totals)}
_ASKED = f"WITH {R.PAPERS}, {E.L}, a AS (SELECT event_id AS seq, user_id * 9 - 3 AS row_no, CASE event_type WHEN 'click' THEN 'rel' WHEN 'view' THEN 'irrel' WHEN 'error' THEN NULL ELSE event_type END AS label FROM events)"
SQL |= {
    "label_rows": f"""{_ASKED}, t AS (SELECT paper_id, arg_max(a.label, seq) AS label FROM a JOIN papers ON pos + 1 = row_no WHERE a.label IN ('rel', 'irrel') GROUP BY paper_id)
SELECT coalesce(l.paper_id, t.paper_id) AS paper_id, coalesce(t.label, l.label) AS label FROM lab l FULL JOIN t ON l.paper_id = t.paper_id""",
    "label_refused": f"{_ASKED} SELECT seq, CASE WHEN label IS NULL OR label NOT IN ('rel', 'irrel') THEN 'no such label' ELSE 'no such row' END AS reason FROM a WHERE label IS NULL OR label NOT IN ('rel', 'irrel') OR row_no - 1 NOT IN (SELECT pos FROM papers)",
    "snapshot_totals": f"{E.SNAP}, g AS (SELECT a AS label, b AS split FROM (VALUES ('rel'), ('irrel'), ('unjudged')) x(a), (VALUES ('anchor'), ('dev'), ('test'), ('unjudged')) y(b)) SELECT g.label, g.split, count(s.id) AS n FROM g LEFT JOIN snap s ON coalesce(s.label, 'unjudged') = g.label AND s.split = g.split GROUP BY ALL",
}
