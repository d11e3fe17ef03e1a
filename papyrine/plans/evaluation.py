"""Ranking heads, metrics, splits, snapshots and tuning, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators import metrics as M
from papyrine.operators import ranking as K
from papyrine.operators import retrieval as V
from papyrine.operators import splits as S
from papyrine.plans import retrieval as R
from papyrine.sources.tables import checkpointed, is_anchor, labels, papers, table

N = 6
TRIALS_DRAWN = 1000


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, N).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def head(spark, d, ranked: DataFrame | None = None) -> DataFrame:
    """The funnel (of the hybrid ranking, if there is none yet) with frozen scores (n_chars % 11)."""
    p = papers(spark, d)
    h = K.funnel(R.hybrid(spark, d) if ranked is None else ranked).join(p.select("pos", "paper_id", (F.col("n_chars") % 11).alias("score")), "pos")
    return h.select("pos", "paper_id", "rank", F.col("score").cast("double").alias("score"))


def scored(spark, d, missing: bool = False, ranked: DataFrame | None = None) -> DataFrame:
    h = head(spark, d, ranked)
    scores = h.where("pos % 13 <> 0") if missing else h
    return K.with_frozen(h.drop("score"), scores.select("paper_id", "score"))


def frozen_scores(spark, d):
    return scored(spark, d, True).select("paper_id", "rank", "score", "failed")


def score_batches(spark, d):
    return K.batches(head(spark, d)).select("paper_id", "batch", "place")


def rank_final(spark, d):
    bonus = (F.col("pos") % 3).cast("double") / 4
    return K.final_order(scored(spark, d), bonus).select("paper_id", "score", F.col("final_rank").alias("rank"))


def rank_fallback(spark, d):
    s = scored(spark, d).withColumn("failed", F.lit(True))
    return K.final_order(s).select("paper_id", "score", "reason", F.col("final_rank").alias("rank"))


def recommended(spark, d):
    return rank_final(spark, d).where(F.col("score") >= K.RELEVANT).select("paper_id", "score")


def exploration(spark, d):
    """Of the final list by rank alone, what is not recommended."""
    top = rank_fallback(spark, d).select("paper_id", "score")
    return top.join(top.where(F.col("score") >= K.RELEVANT).select("paper_id"), "paper_id", "left_anti").select("paper_id", "score")


def relevant_count(spark, d):
    return rank_final(spark, d).agg(F.count_if(F.col("score") >= K.RELEVANT).alias("n"))


def methods(spark, d) -> DataFrame:
    """The rankings of four methods; each is made once, the fused one from the others and the scored one from that."""
    key = lambda df, name: df.select(F.lit(name).alias("method"), F.col("pos").cast("string").alias("paper_id"), "rank")
    words = checkpointed(R.bm25(spark, d).select("pos", "rank"))
    fused = checkpointed(R.hybrid(spark, d, words).select("pos", "rank"))
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "pos").join(papers(spark, d).select("pos"), "pos", "left_semi")
    dense = V.dense_rank(vectors, R.query_vector(spark, d), "pos")  # papers are picked first, so ranks have no gaps
    final = K.final_order(scored(spark, d, ranked=fused), top_k=K.FUNNEL).select("pos", F.col("final_rank").alias("rank"))
    return reduce(DataFrame.unionByName, [key(words, "bm25"), key(dense, "dense"), key(fused, "hybrid"), key(final, "scored")])


def ablation(spark, d):
    return rounded(M.judged(methods(spark, d), labels(spark, d)))


def judged_metrics(spark, d):
    hybrid = R.hybrid_rank(spark, d).withColumn("method", F.lit("hybrid"))
    return rounded(M.judged(hybrid, labels(spark, d), 50))


def legacy_metric(spark, d):
    hybrid = R.hybrid_rank(spark, d).withColumn("method", F.lit("hybrid"))
    return rounded(M.legacy(hybrid, labels(spark, d), 50))


def classification_metrics(spark, d):
    s = papers(spark, d).select("paper_id", (F.col("n_chars") % 11).alias("score")).join(labels(spark, d), "paper_id", "left")
    return rounded(M.classification(s))


def trials(spark, d) -> DataFrame:
    return M.judged(M.random_trials(papers(spark, d), TRIALS_DRAWN, 10, 42), labels(spark, d), 10, "trial")


def random_baseline(spark, d):
    return rounded(trials(spark, d).select("trial", "precision", "recall", "coverage"))


def estimate(spark, d):
    return rounded(M.estimate(trials(spark, d), "precision", "recall", "coverage"))


def fmt_metrics(spark, d):
    show = lambda c: F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("N/A"))
    return judged_metrics(spark, d).select("method", F.concat_ws(" ", show("precision"), show("recall"), show("f1"), show("coverage")).alias("text"))


def stratified_split(spark, d):
    return S.stratified(labels(spark, d))


def snap(spark, d) -> DataFrame:
    p = papers(spark, d)
    scores = p.where("pos % 3 = 0").select("paper_id", (F.col("n_chars") % 11).cast("double").alias("score"))
    return S.snapshot(p, labels(spark, d), scores, is_anchor(F.col("pos")))


def snapshot_build(spark, d):
    return snap(spark, d)


def snapshot_split(spark, d):
    return S.of_split(snap(spark, d), "test").select("id", "label", "split")


def snapshot_verify(spark, d):
    """A snapshot with a score out of range, an anchor among dev and a judged record moved from its split."""
    held = snap(spark, d)
    split = F.when(F.col("id") == "7", "dev").when(F.col("id") == "11", F.when(F.col("split") == "dev", "test").otherwise("dev")).otherwise(F.col("split"))
    tampered = held.withColumn("split", split).withColumn("score", F.when(F.col("id") == "3", 99.0).otherwise(F.col("score")))
    return S.verify(tampered, S.digest(held))


def snapshot_digest(spark, d):
    return S.digest(snap(spark, d))


WEIGHTS = [0.0, 1.0, 2.0, 3.0, 5.0, 8.0]


def sweep(spark, d) -> DataFrame:
    """Judged metrics of each weight by split: the head ordered by score and weighted bonus."""
    s = scored(spark, d).withColumn("unit", (F.col("pos") % 7).cast("double") / 7)
    w = spark.createDataFrame([(x,) for x in WEIGHTS], "weight double")
    ordered = s.crossJoin(F.broadcast(w))  # thirty rows and six weights
    parts = []
    split = S.stratified(labels(spark, d))
    for name, other in (("dev", "test"), ("test", "dev")):
        kept = ordered.join(split.where(F.col("split") == other).select("paper_id"), "paper_id", "left_anti")
        place = F.row_number().over(Window.partitionBy("weight").orderBy(F.desc(F.round(F.col("score") + F.col("weight") * F.col("unit"), 9)), "rank"))
        m = M.judged(kept.withColumn("rank", place), split.where(F.col("split") == name).select("paper_id", "label"), 10, "weight")
        parts.append(m.withColumn("split", F.lit(name)))
    return parts[0].unionByName(parts[1])


def tune_sweep(spark, d):
    return rounded(sweep(spark, d).where("split = 'dev'").select("weight", "precision", "recall", "f1", "coverage"), "weight")


def tune_select(spark, d):
    m = sweep(spark, d)
    low = lambda c: F.coalesce(c, F.lit(-1.0))
    key = F.struct(low("f1"), low("precision"), low("recall"), low("coverage"), -F.abs("weight"), -F.col("weight"))
    best = m.where("split = 'dev'").agg(F.max_by("weight", key).alias("weight"))
    return rounded(m.where("split = 'test'").join(F.broadcast(best), "weight").select("weight", "precision", "recall", "f1", "coverage"), "weight")


# -- SQL ------------------------------------------------------------------------------------------
L = "lab AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN quality = 1 THEN 'rel' ELSE 'irrel' END AS label FROM labels)"
HEAD = f"{R.HYBRID}, {L}, head AS (SELECT f.pos, CAST(f.pos AS VARCHAR) AS paper_id, f.rank, CAST(p.n_chars % 11 AS DOUBLE) AS score FROM fused f JOIN papers p USING (pos) WHERE f.rank <= 30)"
FINAL = f"{HEAD}, fin AS (SELECT paper_id, score, row_number() OVER (ORDER BY score + (pos % 3) / 4.0::DOUBLE DESC, rank) AS rank FROM head QUALIFY rank <= 5)".replace("QUALIFY rank", "QUALIFY row_number() OVER (ORDER BY score + (pos % 3) / 4.0::DOUBLE DESC, rank)")


def JUDGED(rankings: str, k: int, by: str = "method", labs: str = "lab", name: str = "jm") -> str:
    return f"""{name}_c AS (SELECT {by}, count(*) FILTER (label = 'rel') AS rel, count(label) AS judged, count(*) AS size FROM {rankings} r LEFT JOIN {labs} l USING (paper_id) WHERE rank <= {k} GROUP BY {by}),
{name} AS (SELECT {by}, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(judged::DOUBLE / size, 6) AS coverage, rel, judged, n_rel, size
 FROM (SELECT *, CASE WHEN judged > 0 THEN rel::DOUBLE / judged END AS p, CASE WHEN n_rel > 0 THEN rel::DOUBLE / n_rel END AS r FROM {name}_c, (SELECT count(*) AS n_rel FROM {labs} WHERE label = 'rel')))"""


SPLIT = """sp AS (SELECT paper_id, label, CASE WHEN place <= CASE WHEN n = 1 THEN 1 ELSE least(greatest(round_even(n * 0.7::DOUBLE, 0), 1), n - 1) END THEN 'dev' ELSE 'test' END AS split
 FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY sha256('20260717:' || label || ':' || paper_id), paper_id) AS place FROM {src}))"""
SNAP = f"WITH {R.PAPERS}, {L}, fr AS (SELECT l.* FROM lab l WHERE CAST(paper_id AS BIGINT) % 50 <> 7), {SPLIT.format(src='fr')}, " + """snap AS (
 SELECT p.paper_id AS id, title, summary, l.label, p.pos % 50 = 7 AS is_anchor, CASE WHEN p.pos % 3 = 0 THEN CAST(n_chars % 11 AS DOUBLE) END AS score, CASE WHEN p.pos % 3 = 0 THEN 'frozen' END AS reason,
  CASE WHEN p.pos % 50 = 7 THEN 'anchor' ELSE coalesce(sp.split, 'unjudged') END AS split FROM papers p LEFT JOIN lab l USING (paper_id) LEFT JOIN sp USING (paper_id))"""
HY = "hy AS (SELECT 'hybrid' AS method, CAST(pos AS VARCHAR) AS paper_id, rank FROM fused)"
TRIALS = f"""WITH {R.PAPERS}, {L}, tr AS (SELECT trial, paper_id, rank FROM (SELECT t.trial, paper_id, row_number() OVER (PARTITION BY t.trial ORDER BY sha256('42:' || t.trial || ':' || paper_id)) AS rank
 FROM papers, (SELECT unnest(range({TRIALS_DRAWN})) AS trial) t) WHERE rank <= 10), {JUDGED('tr', 10, 'trial')}"""
RAW = TRIALS.replace("round(p, 6)", "p").replace("round(r, 6)", "r").replace("round(judged::DOUBLE / size, 6)", "judged::DOUBLE / size")
SWEEP = f"""{HEAD}, {SPLIT.format(src='lab')},
od AS (SELECT w.weight, h.* FROM (SELECT pos, paper_id, rank AS hr, score FROM head) h, (SELECT unnest([0.0::DOUBLE, 1, 2, 3, 5, 8]) AS weight) w),
dv AS (SELECT weight, paper_id, row_number() OVER (PARTITION BY weight ORDER BY round(score + weight * ((pos % 7)::DOUBLE / 7), 9) DESC, hr) AS rank FROM od WHERE paper_id NOT IN (SELECT paper_id FROM sp WHERE split = 'test')),
te AS (SELECT weight, paper_id, row_number() OVER (PARTITION BY weight ORDER BY round(score + weight * ((pos % 7)::DOUBLE / 7), 9) DESC, hr) AS rank FROM od WHERE paper_id NOT IN (SELECT paper_id FROM sp WHERE split = 'dev')),
dl AS (SELECT paper_id, label FROM sp WHERE split = 'dev'), tl AS (SELECT paper_id, label FROM sp WHERE split = 'test'),
{JUDGED('dv', 10, 'weight', 'dl', 'dm')}, {JUDGED('te', 10, 'weight', 'tl', 'tm')}"""
ALL = f"""{HEAD}, allm AS (SELECT 'bm25' AS method, CAST(pos AS VARCHAR) AS paper_id, rank FROM bm25 UNION ALL
 SELECT 'dense', CAST(pos AS VARCHAR), rank FROM dp UNION ALL SELECT 'hybrid', CAST(pos AS VARCHAR), rank FROM fused UNION ALL
 SELECT 'scored', paper_id, row_number() OVER (ORDER BY score DESC, rank) FROM head), {JUDGED('allm', 10)}"""
CLASS = f"""WITH {R.PAPERS}, {L}, c AS (SELECT count(*) FILTER (s >= 7 AND label = 'rel') AS tp, count(*) FILTER (s >= 7 AND label = 'irrel') AS fp, count(*) FILTER (s < 7 AND label = 'rel') AS fn, count(*) FILTER (s < 7 AND label = 'irrel') AS tn
 FROM (SELECT n_chars % 11 AS s, label FROM papers JOIN lab USING (paper_id))), x AS (SELECT *, (tp + tn) / n::DOUBLE AS a, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r, tn / (tn + fp)::DOUBLE AS s,
 ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)::DOUBLE AS e FROM (SELECT *, tp + fp + fn + tn AS n FROM c))
SELECT tp, fp, fn, tn, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(s, 6) AS specificity, round((r + s) / 2, 6) AS balanced_accuracy,
 round((a - e) / (1 - e), 6) AS kappa, round(greatest(tp + fn, tn + fp) / n::DOUBLE, 6) AS majority FROM x"""
RULES = {
    "anchor flag": "is_anchor <> (split = 'anchor')", "blank title": "trim(title) = ''", "label value": "label IS NOT NULL AND label NOT IN ('rel', 'irrel')",
    "repeated id": "n > 1", "score range": "score IS NOT NULL AND NOT score BETWEEN 0 AND 10", "score with reason": "(score IS NULL) <> (reason IS NULL)",
    "split of judged": "label IS NOT NULL AND split = 'unjudged'", "split of unjudged": "label IS NULL AND split NOT IN ('anchor', 'unjudged')",
    "split value": "split NOT IN ('anchor', 'dev', 'test', 'unjudged')",
}
TAMPERED = f"{SNAP}, tp AS (SELECT id, title, label, is_anchor, CASE WHEN id = '3' THEN 99 ELSE score END AS score, reason, CASE WHEN id = '7' THEN 'dev' WHEN id = '11' THEN CASE WHEN split = 'dev' THEN 'test' ELSE 'dev' END ELSE split END AS split, split AS old, count(*) OVER (PARTITION BY id) AS n FROM snap)"
QUERIES = {f.__name__: f for f in (frozen_scores, score_batches, rank_final, rank_fallback, recommended, exploration, relevant_count, ablation, judged_metrics, legacy_metric, classification_metrics, random_baseline, estimate, fmt_metrics, stratified_split, snapshot_build, snapshot_split, snapshot_verify, snapshot_digest, tune_sweep, tune_select)}
SQL = {
    "frozen_scores": f"{HEAD} SELECT paper_id, rank, CASE WHEN pos % 13 = 0 THEN 0 ELSE score END AS score, (SELECT bool_or(pos % 13 = 0) FROM head) AS failed FROM head",
    "score_batches": f"{HEAD} SELECT paper_id, CAST(floor((row_number() OVER (ORDER BY rank) - 1) / 8) AS BIGINT) AS batch, (row_number() OVER (ORDER BY rank) - 1) % 8 + 1 AS place FROM head",
    "rank_final": f"{FINAL} SELECT * FROM fin",
    "rank_fallback": f"{HEAD} SELECT paper_id, score, '{K.FALLBACK_REASON}' AS reason, rank FROM head WHERE rank <= 5",
    "recommended": f"{FINAL} SELECT paper_id, score FROM fin WHERE score >= 7",
    "exploration": f"{HEAD} SELECT paper_id, score FROM head WHERE rank <= 5 AND score < 7",
    "relevant_count": f"{FINAL} SELECT count(*) FILTER (score >= 7) AS n FROM fin",
    "ablation": f"{ALL} SELECT method, precision, recall, f1, coverage, rel, judged, n_rel FROM jm",
    "judged_metrics": f"{R.HYBRID}, {L}, {HY}, {JUDGED('hy', 50)} SELECT method, precision, recall, f1, coverage, rel, judged, n_rel FROM jm",
    "legacy_metric": f"{R.HYBRID}, {L}, {HY}, {JUDGED('hy', 50)} SELECT method, round(rel::DOUBLE / size, 6) AS precision, coalesce(recall, 0) AS recall, judged FROM jm",
    "classification_metrics": CLASS,
    "random_baseline": f"{TRIALS} SELECT trial, precision, recall, coverage FROM jm",
    "estimate": f"{RAW} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, count({m}) AS valid FROM jm" for m in ("precision", "recall", "coverage")),
    "fmt_metrics": f"{R.HYBRID}, {L}, {HY}, {JUDGED('hy', 50)} SELECT method, concat_ws(' ', " + ", ".join(f"coalesce(printf('%.3f', {m}), 'N/A')" for m in ("precision", "recall", "f1", "coverage")) + ") AS text FROM jm",
    "stratified_split": f"WITH {L}, {SPLIT.format(src='lab')} SELECT paper_id, label, split FROM sp",
    "snapshot_build": f"{SNAP} SELECT * FROM snap",
    "snapshot_split": f"{SNAP} SELECT id, label, split FROM snap WHERE split NOT IN ('anchor', 'dev')",
    "snapshot_verify": f"{TAMPERED} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({x}) AS violations FROM tp" for n, x in RULES.items())
    + " UNION ALL SELECT 'split made again', count(*) FROM tp WHERE NOT is_anchor AND label IS NOT NULL AND split <> old UNION ALL SELECT 'stored digest', 1",
    "snapshot_digest": f"{SNAP} SELECT count(*) AS records, CAST(sum(CAST(('0x' || substr(sha256(CAST(to_json(x) AS VARCHAR)), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM (SELECT {{'id': id, 'title': title, 'summary': summary, 'label': label, 'is_anchor': is_anchor, 'score': score, 'reason': reason, 'split': split}} AS x FROM snap)",
    "tune_sweep": f"{SWEEP} SELECT weight, precision, recall, f1, coverage FROM dm",
    "tune_select": f"""{SWEEP} SELECT weight, precision, recall, f1, coverage FROM tm WHERE weight = (SELECT weight FROM dm
 ORDER BY coalesce(f1, -1) DESC, coalesce(precision, -1) DESC, coalesce(recall, -1) DESC, coalesce(coverage, -1) DESC, abs(weight), weight LIMIT 1)""",
}
