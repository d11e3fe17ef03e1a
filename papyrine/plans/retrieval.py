"""Retrieval queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import paper_text
from papyrine.functions.vector import cosine
from papyrine.operators import retrieval as R
from papyrine.operators.ranking import funnel
from papyrine.sources.tables import papers, table



def text():
    return paper_text(F.col("title"), F.col("summary"))


def question(spark: SparkSession, d: str) -> str:
    return table(spark, d, "benchmark").where("item_id = 0").select("text").first()[0]


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def dense(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_rank(table(spark, d, "embeddings"), query_vector(spark, d))


def bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_rank(papers(spark, d), text(), question(spark, d))


def cosine_rank(spark, d):
    return dense(spark, d).select("vec_id", F.round("sim", 6).alias("sim"), "rank")


def bm25_stats(spark, d):
    p = papers(spark, d)
    return R.idf_table(p, text()).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_rank(spark, d):
    return bm25(spark, d).select(F.col("pos").cast("string").alias("paper_id"), F.round("score", 6).alias("score"), "rank")


def bm25_bg(spark, d):
    p = papers(spark, d)
    ranked = R.bm25_rank(p.where("lang = 'en'"), text(), question(spark, d), p.where("lang <> 'en'"))
    return ranked.select(F.col("pos").cast("string").alias("paper_id"), F.round("score", 6).alias("score"), "rank")


def hybrid(spark, d, words: DataFrame | None = None) -> DataFrame:
    """pos, rrf, rank: dense first, then BM25 (words, if ranked already); only vectors of papers take part."""
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "pos").join(papers(spark, d).select("pos"), "pos", "left_semi")
    return R.fuse([R.dense_rank(vectors, query_vector(spark, d), "pos"), bm25(spark, d) if words is None else words])


def hybrid_rank(spark, d):
    return hybrid(spark, d).select(F.col("pos").cast("string").alias("paper_id"), F.round("rrf", 9).alias("rrf"), "rank")


def rrf_fuse(spark, d):
    a = dense(spark, d).select(F.col("vec_id").alias("pos"), "rank")
    return R.fuse([a, bm25(spark, d)]).select("pos", F.round("rrf", 9).alias("rrf"), "rank")


def llm_candidates(spark, d):
    return funnel(hybrid(spark, d)).select(F.col("pos").cast("string").alias("paper_id"), "rank")


def pref_bonus(spark, d):
    e = table(spark, d, "embeddings")
    liked = F.broadcast(e.where("vec_id BETWEEN 1 AND 3").select(F.col("embedding").alias("a"), F.lit(1).alias("sign")))
    disliked = F.broadcast(e.where("vec_id IN (4, 5)").select(F.col("embedding").alias("a"), F.lit(-1).alias("sign")))
    sims = e.crossJoin(liked.unionByName(disliked)).select("vec_id", "sign", cosine(F.col("embedding"), F.col("a")).alias("sim"))  # five anchors
    mean = lambda s: F.coalesce(F.avg(F.when(F.col("sign") == s, F.col("sim"))), F.lit(0.0))
    return sims.groupBy("vec_id").agg(F.round(mean(1) - mean(-1), 6).alias("bonus"))


# -- SQL ------------------------------------------------------------------------------------------
COS = "coalesce(CASE WHEN isfinite({0}) THEN {0} END, 0)".format("list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))")
Q = "(SELECT text FROM benchmark WHERE item_id = 0)"
PAPERS = "papers AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS paper_id, split_part(text, '.', 1) AS title, text AS summary, lang, source AS category, n_chars FROM documents)"
DENSE = f"dense AS (SELECT vec_id, sim, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM (SELECT e.vec_id, round({COS.format(a='e.embedding', b='q.embedding')}, 9) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q))"


def BM25(where: str = "TRUE", name: str = "bm25") -> str:
    return f"""
tok AS (SELECT pos, lang, regexp_extract_all(lower(title || '. ' || summary), '[a-z0-9]+') AS ts FROM papers),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM tok) GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM tok) - df + 0.5) - ln(df + 0.5) AS raw FROM df),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT term, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower({Q}), '[a-z0-9]+')) AS term) GROUP BY term),
tf AS (SELECT pos, len(ts) AS dl, term, count(*) AS tf FROM (SELECT pos, ts, unnest(ts) AS term FROM tok WHERE {where}) GROUP BY pos, len(ts), term),
sc AS (SELECT pos, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(len(ts)) FROM tok)))) AS s FROM tf JOIN qt USING (term) JOIN idf USING (term) GROUP BY pos),
{name} AS (SELECT pos, score, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM (SELECT pos, round(coalesce(s, 0), 9) AS score FROM tok LEFT JOIN sc USING (pos) WHERE {where}))"""


def FUSED(first: str, second: str = "bm25") -> str:
    return f"""
lists AS (SELECT pos, 0 AS l, rank FROM {first} UNION ALL SELECT pos, 1, rank FROM {second}),
fsum AS (SELECT pos, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, min(l * 10000000000 + rank) AS f FROM lists GROUP BY pos),
fused AS (SELECT pos, rrf, row_number() OVER (ORDER BY rrf DESC, f) AS rank FROM fsum)"""


EN = "lang = 'en'"
DENSE_PAPERS = "dp AS (SELECT vec_id AS pos, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM dense WHERE vec_id IN (SELECT pos FROM papers))"
HYBRID = f"WITH {PAPERS}, {DENSE}, {DENSE_PAPERS}, {BM25()}, {FUSED('dp')}"

QUERIES = {f.__name__: f for f in (cosine_rank, bm25_stats, bm25_rank, bm25_bg, hybrid_rank, rrf_fuse, llm_candidates, pref_bonus)}
SQL = {
    "cosine_rank": f"WITH {DENSE} SELECT vec_id, round(sim, 6) AS sim, rank FROM dense",
    "bm25_stats": f"""WITH {PAPERS}, tok AS (SELECT list_distinct(regexp_extract_all(lower(title || '. ' || summary), '[a-z0-9]+')) AS ts FROM papers), n AS (SELECT count(*) AS n FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(ts) AS term FROM tok) GROUP BY term), raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), m AS (SELECT avg(raw) AS m FROM raw)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25::DOUBLE * m ELSE raw END, 6) AS idf FROM raw, m""",
    "bm25_rank": f"WITH {PAPERS}, {BM25()} SELECT CAST(pos AS VARCHAR) AS paper_id, round(score, 6) AS score, rank FROM bm25",
    "bm25_bg": f"WITH {PAPERS}, {BM25(EN)} SELECT CAST(pos AS VARCHAR) AS paper_id, round(score, 6) AS score, rank FROM bm25",
    "hybrid_rank": f"{HYBRID} SELECT CAST(pos AS VARCHAR) AS paper_id, round(rrf, 9) AS rrf, rank FROM fused",
    "rrf_fuse": f"WITH {PAPERS}, {DENSE}, da AS (SELECT vec_id AS pos, rank FROM dense), {BM25()}, {FUSED('da')} SELECT pos, round(rrf, 9) AS rrf, rank FROM fused",
    "llm_candidates": f"{HYBRID} SELECT CAST(pos AS VARCHAR) AS paper_id, rank FROM fused WHERE rank <= 30",
    "pref_bonus": f"""SELECT vec_id, round(coalesce(avg(sim) FILTER (s = 1), 0) - coalesce(avg(sim) FILTER (s = -1), 0), 6) AS bonus
FROM (SELECT e.vec_id, a.s, {COS.format(a='e.embedding', b='a.embedding')} AS sim
      FROM embeddings e, (SELECT embedding, CASE WHEN vec_id <= 3 THEN 1 ELSE -1 END AS s FROM embeddings WHERE vec_id BETWEEN 1 AND 5) a) GROUP BY vec_id""",
}
