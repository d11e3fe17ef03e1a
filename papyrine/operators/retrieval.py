"""Dense, BM25 and fused rankings as plans."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import tokenize
from papyrine.functions.vector import cosine
from papyrine.operators.ranking import global_rank
from papyrine.sources.tables import checkpointed

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60


def dense_rank(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, sim and rank of all vectors by cosine with one query vector; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sims = vectors.select(key, F.round(cosine(F.col(vector), q), 9).alias("sim"))
    return global_rank(sims, F.desc("sim"), F.col(key))


#: Queries that a task holds at once, and rows that it multiplies with them at once.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=(norm > 0) & np.isfinite(norm))


def dense_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "pos", query: str = "item_id", vector: str = "embedding") -> DataFrame:
    """query, key, sim and rank of the k nearest of all vectors for each query, by cosine; ties by key. A vector without a direction has 0 with all.

    queries may be any number: they are taken in blocks of QUERY_BLOCK, and each block meets the vectors in matrix products of a task's Arrow
    batches. Of a partition only k rows a query leave it. All vectors have one length; rows with a null vector or key are left out.
    """
    queries = queries.where(F.col(vector).isNotNull() & F.col(query).isNotNull()).select(F.col(query).cast("long").alias(query), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    queries = checkpointed(queries.withColumn("_at", F.monotonically_increasing_id()))
    order = global_rank(queries.select(F.col("_at").alias("_q")), F.col("_q")) if queries.count() > QUERY_BLOCK else queries.select(F.col("_at").alias("_q"), F.lit(1).alias("rank"))
    blocked = queries.join(order, F.col("_at") == F.col("_q")).withColumn("block", F.floor((F.col("rank") - 1) / QUERY_BLOCK))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("c"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    found = None
    for (block,) in sorted(blocked.select("block").distinct().collect()):
        part = blocked.where(F.col("block") == block).select(query, "v").toArrow()  # QUERY_BLOCK at most
        near = rows.mapInArrow(_nearest(part.column(query).to_numpy(), part.column("v").combine_chunks(), k), "q long, c long, sim double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"{query} long, {key} long, sim double, rank long")
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("c").alias(key), "sim", "rank")


def _nearest(ids: np.ndarray, vectors: pa.Array, k: int):
    d = len(vectors[0])
    asks = _unit(vectors, d)

    def run(batches):
        sims, keys = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                own = part.column("c").to_numpy()
                s = np.concatenate([sims, np.round(asks @ _unit(part.column("v"), d).T, 9) + 0.0], 1)
                c = np.concatenate([keys, np.broadcast_to(own, (len(ids), len(own)))], 1)
                top = np.lexsort((c, -s), axis=1)[:, :k]
                sims, keys = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        real = np.isfinite(sims)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(keys[real]), pa.array(sims[real])], ["q", "c", "sim"])

    return run


def idf_table(docs: DataFrame, text: Column) -> DataFrame:
    """term, df and idf; negative idf becomes EPSILON times the vocabulary's mean before replacement."""
    df = docs.select(F.explode(F.array_distinct(tokenize(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = df.crossJoin(F.broadcast(n)).withColumn("raw", raw)  # one row
    mean = df.agg(F.avg("raw").alias("mean"))
    df = df.crossJoin(F.broadcast(mean))
    return df.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_rank(docs: DataFrame, text: Column, query: str, background: DataFrame | None = None, key: str = "pos") -> DataFrame:
    """key, score and rank of all docs; ties by key. Statistics are over docs and background.

    The query's terms are literals, so of a document only its length and its postings of them leave the first
    pass; a second one counts the vocabulary, whose mean idf replaces negative ones.
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(tokenize(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    asked = {r.term: r.times for r in asked.collect()}  # a query's terms
    held = docs.select(key, tokenize(text).alias("tokens"))
    held = checkpointed(held.select(key, F.size("tokens").alias("dl"), F.filter("tokens", lambda x: x.isin(*asked)).alias("hits")))
    corpus, lengths = docs.select(text.alias("t")), held.select("dl")
    if background is not None:
        corpus = corpus.unionByName(background.select(text.alias("t")))
        lengths = lengths.unionByName(background.select(F.size(tokenize(text)).alias("dl")))
    stats = F.broadcast(lengths.agg(F.avg("dl").alias("avgdl")))  # one row
    terms = F.broadcast(spark.createDataFrame(list(asked.items()), "term string, times long"))
    weights = F.broadcast(idf_table(corpus, F.col("t")).join(terms, "term"))  # at most the query's terms
    hits = held.select(key, "dl", F.explode("hits").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    hits = hits.join(weights, "term").crossJoin(stats)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy(key).agg(F.sum(part).alias("score"))
    scored = held.select(key).join(scores, key, "left").select(key, F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    return global_rank(scored, F.desc("score"), F.col(key))


def fuse(rankings: list[DataFrame], key: str = "pos", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists; ties by the place in the first list that has the key."""
    parts = [r.select(key, F.lit(i).alias("list"), "rank") for i, r in enumerate(rankings)]
    both = reduce(DataFrame.unionByName, parts)
    fused = both.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("list", "rank")).alias("first"))
    fused = fused.withColumn("rrf", F.round("rrf", 12))
    return global_rank(fused, F.desc("rrf"), F.col("first.list"), F.col("first.rank")).select(key, "rrf", "rank")
